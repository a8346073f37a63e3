"""What plans need of the session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where none is set and all runs in one process (tests), a temporary folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinsieve-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def released(spark: SparkSession) -> None:
    """Asks for the end of shuffle files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialized(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it outlives lost executors, ends the lineage, and its size is known."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/kinsieve/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df  # the last reference to its shuffles, unless the caller keeps one
    released(spark)
    return spark.read.schema(schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, unless their PYTHONPATH, which they have from here, names it already."""
    home = Path(__file__).resolve().parent.parent.parent
    named = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if home in named or app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="kinsieve-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
