"""From edges to findings: components, the clique test, and exclusive pairs for the rest."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: Edges of a component that one task may match; larger components are matched in rounds.
TASK_EDGES = 50_000
ORDER = ["left_size", "left_id", "tie_rank", "right_size", "right_id"]


def with_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``edges`` with the component (its least form id)."""
    edges = keep(edges)
    roots = connected_components(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), keep)
    return edges.join(roots.select(F.col("node").alias("left_id"), F.col("root").alias("component")), "left_id")


def component_stats(edges: DataFrame) -> DataFrame:
    """(component, forms, edges, score, closed): closed if every pair is an edge; score is the least one."""
    nodes = edges.select("component", F.explode(F.array("left_id", "right_id")).alias("form_id")).distinct().groupBy("component").agg(F.count("*").alias("forms"))
    some = edges.groupBy("component").agg(F.count("*").alias("edges"), F.min("score").alias("score"))
    return nodes.join(some, "component").withColumn("closed", F.col("edges") * 2 == F.col("forms") * (F.col("forms") - 1))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", *ORDER], ascending=[False] + [True] * len(ORDER), kind="stable")
    used: set[int] = set()
    kept = []
    for k, (a, b) in enumerate(zip(pdf["left_id"], pdf["right_id"], strict=True)):
        if a not in used and b not in used:
            used |= {a, b}
            kept.append(k)
    return pdf.iloc[kept][["left_id", "right_id", "score"]]


def _dominant(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same matching without gathering a component: in each round edges that are the best of both their ends are taken."""
    rank = F.struct(-F.col("score"), *(F.col(c) for c in ORDER))
    left, taken = keep(edges), None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("left_id", "right_id")).alias("form_id"), rank.alias("rank")).groupBy("form_id").agg(F.min("rank").alias("best"))
        side = lambda c: ends.select(F.col("form_id").alias(c), F.col("best").alias(f"{c}_best"))  # noqa: E731,B023
        now = keep(left.join(side("left_id"), "left_id").join(side("right_id"), "right_id").where((F.col("left_id_best") == rank) & (F.col("right_id_best") == rank)).select(*left.columns))
        gone = now.select(F.explode(F.array("left_id", "right_id")).alias("form_id"))
        taken = now if taken is None else taken.union(now)
        left = keep(left.join(gone.withColumnRenamed("form_id", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("form_id", "right_id"), "right_id", "left_anti").select(*left.columns))
    return (taken if taken is not None else edges.limit(0)).select("left_id", "right_id", "score")


def greedy_pairs(edges: DataFrame, stats: DataFrame, keep: Callable[[DataFrame], DataFrame], task_edges: int = TASK_EDGES) -> DataFrame:
    """Exclusive pairs of open components, the best scores first; ties go by (left, place of the shared key, right). What is left over has no finding."""
    opened = edges.join(stats.where("not closed").select("component", F.col("edges").alias("size")), "component")
    small = opened.where(F.col("size") <= task_edges).select("component", "score", *ORDER).groupBy("component").applyInPandas(_greedy, "left_id bigint, right_id bigint, score double")
    large = opened.where(F.col("size") > task_edges).drop("size", "component")
    if large.isEmpty():
        return small
    return small.union(_dominant(large.select("score", *ORDER), keep))


def open_pairs(parts: DataFrame, stats: DataFrame, ties: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``greedy_pairs`` of edges without a tie_rank: ``ties`` adds it to those of open components."""
    opened = keep(parts.join(stats.where("not closed").select("component"), "component", "left_semi"))
    if opened.isEmpty():
        return opened.select("left_id", "right_id", "score")
    return greedy_pairs(keep(ties(opened)), stats, keep)


def near_members(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], ties: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(finding_key, form_id, score) of near-miss findings: each closed component, and the pairs of open ones."""
    parts = keep(with_components(edges, keep))
    stats = keep(component_stats(parts))
    nodes = parts.select("component", F.explode(F.array("left_id", "right_id")).alias("form_id")).distinct()
    key = lambda *c: F.sha2(F.concat_ws("|", F.lit("type_3"), *(x.cast("string") for x in c)), 256)
    closed = nodes.join(stats.where("closed").select("component", "score"), "component").select(key(F.col("component")).alias("finding_key"), "form_id", "score")
    pairs = open_pairs(parts, stats, ties, keep)
    split = pairs.select(key(F.col("left_id"), F.col("right_id")).alias("finding_key"), F.explode(F.array("left_id", "right_id")).alias("form_id"), "score")
    return closed.union(split)

