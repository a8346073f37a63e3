"""analyze(): from source trees to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.normalize import MARKER, forms_and_bag, normalize_files
from ..sources.files import local_files
from .compare import compare, findings
from .report import Report, build_report
from .session import materialized, ship


def session() -> SparkSession:
    """The running session, or a local one for the command line."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    spark = SparkSession.builder.master("local[*]").appName("kinsieve").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def analyze_files(files: DataFrame, lang: str, threshold: float, min_nodes: int, min_lines: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, members of findings, warnings) of files (file_seq, path, source, warning)."""
    rows = materialized(normalize_files(files, lang, min_nodes, min_lines))
    forms, bag = forms_and_bag(rows)
    warnings = files.where("warning is not null").select("file_seq", F.lit(0).alias("seq"), F.col("warning").alias("message"))
    warnings = warnings.union(rows.where("warning is not null").select("file_seq", "seq", F.col("warning").alias("message")))
    return forms, compare(forms, bag, threshold), warnings


def analyze(spark: SparkSession, roots: list[str], config: Config, lang: str) -> Report:
    """The report of local source trees. Files that can't be read or parsed are warnings."""
    ship(spark)
    walk = config.walk
    files = local_files(spark, roots, walk.extensions, walk.exclude, walk.max_file_bytes)
    files = materialized(files)
    forms, members, warnings = analyze_files(files, lang, config.gate.threshold, walk.min_nodes, walk.min_lines)
    messages = [r["message"] for r in warnings.orderBy("file_seq", "seq").select("message").toLocalIterator()]
    unread = files.where("warning is not null").count()
    failed = len(messages) - unread
    scanned = files.count() - unread - failed
    return build_report(f"kinsieve-{lang}", config.gate.threshold, findings(members), scanned, forms.count(), messages)


__all__ = ["MARKER", "analyze", "analyze_files", "session"]
