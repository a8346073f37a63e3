"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spilled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage as checkpoint() does, survives lost executors, and gives
    Catalyst a true size, so that a join broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinsieve/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``spilled`` wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._spilled_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Asks for the end of shuffle files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """The text column as a string, a null text as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
