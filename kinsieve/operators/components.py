"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b): root is the least node of its component.

    Each round re-hangs neighbours onto smaller ones, once upwards and once downwards, until
    each component is a star around its root; that takes a number of rounds logarithmic in the
    components' diameters. Minima are aggregated before the shuffle, kept, and joined back as tables of known size:
    broadcast while they are small, else merged, where adaptive execution splits the rows of a node
    with very many neighbours, so these are never gathered in one place. ``keep`` materialises a
    step's rows (a checkpoint or a written table) and cuts the lineage.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        # large star: the larger neighbours of a node move to its least neighbour
        around = both(now)
        least = keep(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        up = keep(around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and its smaller neighbours move to the least of them
        least = keep(up.groupBy("a").agg(F.min("b").alias("m")))
        down = up.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = keep(down)
        was, seen = seen, mark(now)
        if seen == was:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
