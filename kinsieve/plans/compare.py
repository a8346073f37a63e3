"""compare(): from forms and their bags to findings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import tier_for, type_rank
from ..operators.cluster import near_members
from ..operators.exact import exact_members, form_keys, unclaimed
from ..operators.near import near_miss_edges, with_ties
from ..schema import TYPE_3
from .session import materialized

DEFAULT_THRESHOLD = 0.85


def validate_threshold(threshold: float) -> float:
    if not math.isfinite(threshold) or not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be a finite number from 0 to 1, not {threshold}")
    return float(threshold)


def compare(forms: DataFrame, bag: DataFrame, threshold: float = DEFAULT_THRESHOLD, packed: DataFrame | None = None, counts: Callable[[DataFrame], DataFrame] | None = None, bags: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each member of each finding.

    finding_key, clone_type, tier, score, member_seq (from 1, by path component by component,
    line and name), form_id, path, start_line, end_line, name.

    Exact findings come first and claim their forms; what is left is matched by similarity at
    ``threshold`` or more, below 1. Forms without a bag are in no finding. ``packed`` has the forms' packed bags
    where they can be made inside their rows, ``counts`` gives in how many of the forms it is given each fingerprint is,
    ``bags`` their bags.
    """
    validate_threshold(threshold)
    keys = materialized(form_keys(forms, bag) if packed is None else packed.drop("bag"))
    exact = exact_members(keys).withColumn("score", F.lit(1.0))
    rest = materialized(unclaimed(keys))
    edges = near_miss_edges(rest, bag, threshold, materialized, packed)
    near = near_members(edges, materialized, lambda e: with_ties(e, rest, bag, materialized, counts, bags)).select("finding_key", F.lit(TYPE_3).alias("clone_type"), "form_id", "score")
    members = exact.unionByName(near).join(forms.select(F.col("id").alias("form_id"), "path", "start_line", "end_line", "name"), "form_id")
    order = Window.partitionBy("finding_key").orderBy(F.split("path", "/"), "start_line", "name", "form_id")
    return members.select(
        "finding_key", "clone_type", tier_for(F.col("score")).alias("tier"), "score",
        F.row_number().over(order).alias("member_seq"), "form_id", "path", "start_line", "end_line", "name",
    )


def findings(members: DataFrame) -> DataFrame:
    """One row for each finding, its members as an ordered array."""
    item = F.struct("member_seq", "path", "start_line", "end_line", "name")
    return members.groupBy("finding_key", "clone_type", "tier", "score").agg(F.array_sort(F.collect_list(item)).alias("members"))


def numbered(rows: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with their place, from 1, in the order given: sorted by ranges, counted by partition, numbered from the partitions' offsets."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = keep(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")


def ordered(found: DataFrame) -> DataFrame:
    """Findings by score, best first, then by the first member's displayed path, line and name, type-1 before type-2."""
    first = F.get("members", F.lit(0))
    return found.orderBy(F.desc("score"), first["path"], first["start_line"], first["name"], type_rank(F.col("clone_type")), "finding_key")
