"""Bags (multisets) of structural fingerprints, and the prefixes that a similarity join needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slack for decimal thresholds that binary floats overshoot.
SLACK = 1e-9


def build_bag(parts: DataFrame) -> DataFrame:
    """(form_id, fp, cnt) of rows (form_id, fp)."""
    return parts.groupBy("form_id", "fp").agg(F.count("*").alias("cnt"))


def bag_of_array(forms: DataFrame, form_id: str, fps: str) -> DataFrame:
    """(form_id, fp, cnt) where a row holds all fingerprints of its form: sorted and counted inside the row, without a shuffle."""
    own = forms.select(F.col(form_id).alias("form_id"), F.array_sort(fps).alias("s"))
    head = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    heads = own.where(F.size("s") > 0).select("form_id", "s", head.alias("h"))
    pair = lambda at, k: F.struct(F.get("s", at).alias("fp"), (F.coalesce(F.get("h", k + 1), F.size("s")) - at).cast("bigint").alias("cnt"))
    return heads.select("form_id", F.explode(F.transform("h", pair)).alias("e")).select("form_id", "e.fp", "e.cnt")


def bag_sizes(bag: DataFrame) -> DataFrame:
    """(form_id, bag_size): how many fingerprints a form has, with repeats."""
    return bag.groupBy("form_id").agg(F.sum("cnt").alias("bag_size"))


def fingerprint_df(bag: DataFrame) -> DataFrame:
    """(fp, df): in how many forms a fingerprint occurs."""
    return bag.groupBy("fp").agg(F.count("*").alias("df"))


def prefix_mass(size: Column, threshold: float) -> Column:
    """How much of a bag must be indexed so that no pair at the threshold is missed: n - ceil(t n) + 1; all of it for t <= 0."""
    if threshold <= 0:
        return size.cast("bigint")
    return (size - F.ceil(size * F.lit(float(threshold)) - SLACK) + 1).cast("bigint")


def unsigned_order(fp: Column, kind: str) -> Column:
    """Fingerprints are unsigned; BIGINT isn't."""
    return fp.bitwiseXOR(F.lit(-(1 << 63))) if kind == "bigint" else fp


def prefix_keys(bag: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(form_id, fp, cnt, df, position): rarest fingerprints first, as long as what stands before is less than the prefix mass.

    ``keep`` may write the fingerprints' counts as a table: then they are broadcast while they are small, else
    merged with rows that adaptive execution splits where a fingerprint is in very many forms.
    """
    order = unsigned_order(F.col("fp"), dict(bag.dtypes)["fp"])
    w = Window.partitionBy("form_id").orderBy("df", order)
    ranked = bag.join(keep(fingerprint_df(bag)), "fp").select(
        "form_id", "fp", "cnt", "df",
        (F.row_number().over(w) - 1).cast("bigint").alias("position"),
        F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("cnt").over(Window.partitionBy("form_id")).alias("bag_size"),
    )
    return ranked.where(F.col("before") < prefix_mass(F.col("bag_size"), threshold)).drop("before")


def bag_digest(bag: DataFrame) -> DataFrame:
    """(form_id, bag_key, bag_size): equal bags have equal keys. The key is a SHA-256 of the sorted bag, so groups shuffle 64 characters, not whole bags."""
    item = F.struct("fp", "cnt")
    return bag.groupBy("form_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(item))), 256).alias("bag_key"), F.sum("cnt").alias("bag_size"))


def trace_digest(trace: Column) -> Column:
    """A key of the sequence of identifiers; null traces are empty ones."""
    return F.sha2(F.to_json(F.struct(F.coalesce(trace, F.array().cast("array<string>")).alias("t"))), 256)
