"""Near misses: a multiset-Jaccard self-join by postings of parts, by sketches, by prefixes or block by block."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PRODUCTION
from .bags import SLACK, bag_sizes, fingerprint_df, prefix_keys, unsigned_order
from .dense import dense_counts, dense_scores, few_fingerprints
from .packed import SPLIT_FROM, bags_of, packed_bags, packed_candidates, packed_scores
from .sketch import sketch_scores


def jaccard_maps(left: Column, right: Column) -> Column:
    """Sum of minima over sum of maxima of two maps fp -> cnt; 0 for two empty ones."""
    zero = F.lit(0).cast("bigint")
    common = F.aggregate(F.map_values(F.map_zip_with(left, right, lambda _, a, b: F.least(F.coalesce(a, zero), F.coalesce(b, zero)))), zero, lambda s, x: s + x)
    total = lambda m: F.aggregate(F.map_values(m), zero, lambda s, x: s + x)
    union = total(left) + total(right) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def within_window(small: Column, large: Column, threshold: float) -> Column:
    """Whether two sizes can reach the threshold at all; the score decides, so a little slack does no harm."""
    return F.lit(True) if threshold <= 0 else large <= small / F.lit(float(threshold)) + 1


def size_band(size: Column, threshold: float) -> Column:
    """Bands of sizes, each as wide as the window: what reaches the threshold lies in the smaller size's band or soon above."""
    if threshold <= 0 or threshold >= 1:
        return F.lit(0) if threshold <= 0 else size.cast("int")
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold))).cast("int")


def candidates(remaining: DataFrame, bag: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(left_id, left_size, right_id, right_size, tie_rank) of pairs of one kind that share a prefix key and may reach the threshold; left is the smaller by (size, id).

    tie_rank is the place, in the left prefix, of the first shared key. What two prefixes share is
    known when their pairs are grouped; keys that are shared but not in both prefixes lie behind
    the end of the prefix that ends first, so its form's remaining mass bounds them. Pairs whose bound is
    too small are dropped before any bag is met. The join is on the key, the kind and the band of sizes, so
    forms of all sizes that share a key don't meet.
    """
    order = unsigned_order(F.col("fp"), dict(bag.dtypes)["fp"])
    own = Window.partitionBy("form_id")
    keys = prefix_keys(bag, threshold, keep).withColumns({"rest": F.col("bag_size") - F.sum("cnt").over(own), "end": F.max(F.struct("df", order.alias("o"))).over(own)}).drop("bag_size", "df").join(remaining, "form_id")
    keys = keys.withColumns({"band": size_band(F.col("bag_size"), threshold), "top": size_band(F.col("bag_size") / F.lit(float(threshold)) + 1 if 0 < threshold < 1 else F.col("bag_size") + int(threshold > 0), threshold)})
    side = lambda p: keys.select(*(F.col(c).alias(f"{p}_{c}") for c in ("form_id", "fp", "kind", "bag_size", "position", "cnt", "rest", "end", "band", "top")))
    l_size, r_size = F.col("l_bag_size"), F.col("r_bag_size")
    earlier = (l_size < r_size) | ((l_size == r_size) & (F.col("l_form_id") < F.col("r_form_id")))
    small = side("l").withColumn("l_band", F.explode(F.sequence("l_band", "l_top")))
    pairs = small.join(side("r"), (F.col("l_fp") == F.col("r_fp")) & (F.col("l_kind") == F.col("r_kind")) & (F.col("l_band") == F.col("r_band")) & earlier & within_window(l_size, r_size, threshold))
    behind = F.when(F.col("l_end") <= F.col("r_end"), F.col("l_rest")).otherwise(F.col("r_rest"))
    found = pairs.groupBy(F.col("l_form_id").alias("left_id"), l_size.alias("left_size"), F.col("r_form_id").alias("right_id"), r_size.alias("right_size")).agg(
        F.min("l_position").alias("tie_rank"), F.sum(F.least("l_cnt", "r_cnt")).alias("shared"), F.max(behind).alias("behind")
    )
    t = max(float(threshold), 0.0)
    needed = (F.col("left_size") + F.col("right_size")) * F.lit(t / (1 + t)) - SLACK
    return found.where(F.col("shared") + F.col("behind") >= needed).drop("shared", "behind")


def scored(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """``pairs`` with the exact score. Each pair meets the two bags once, as maps."""
    maps = bag.groupBy("form_id").agg(F.map_from_entries(F.collect_list(F.struct("fp", "cnt"))).alias("m"))
    both = pairs.join(maps.select(F.col("form_id").alias("left_id"), F.col("m").alias("lm")), "left_id").join(maps.select(F.col("form_id").alias("right_id"), F.col("m").alias("rm")), "right_id")
    return both.withColumn("score", jaccard_maps(F.col("lm"), F.col("rm"))).drop("lm", "rm")


def near_miss_edges(remaining: DataFrame, bag: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df, packed: DataFrame | None = None) -> DataFrame:
    """Pairs with threshold <= score < 1: left_id, left_size, right_id, right_size, score. ``remaining`` has form_id, kind and bag_size; other forms' bags are left out.

    The bags that are left are met several times; ``keep`` may materialise them. ``packed`` has the packed bags
    of all forms where they can be made inside their rows, and is then read as often instead. Bags of few fingerprints in all are
    compared block by block, as any two share some; thresholds of SPLIT_FROM and more by postings of parts, lower ones by sketches
    if there are packed bags, else by keys.
    """
    t = float(threshold)
    if packed is None:
        own = keep(bag.join(remaining.select("form_id"), "form_id", "left_semi"))
        if few_fingerprints(own):
            found = dense_scores(own, remaining, t)
        elif t >= SPLIT_FROM:
            found = _by_parts(keep(packed_bags(own, remaining)), remaining, t, keep)
        else:
            found = scored(candidates(remaining, own, threshold, keep), own)
    elif t >= SPLIT_FROM:
        found = _by_parts(packed, remaining, t, keep)
    elif t > 0:
        found = sketch_scores(packed, remaining, t)
    else:
        return near_miss_edges(remaining, bag, threshold, keep)
    return found.where((F.col("score") >= t) & (F.col("score") < 1.0)).select("left_id", "left_size", "right_id", "right_size", "score")


def all_pairs(bag: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All pairs that share a fingerprint, with their score, also equal bags; as ``near_miss_edges`` names them. All forms are of one kind."""
    rest = keep(bag_sizes(bag).withColumn("kind", F.lit(PRODUCTION)))
    found = dense_scores(bag, rest, 0.0) if few_fingerprints(bag) else scored(candidates(rest, bag, 0.0, keep), bag)
    return found.select("left_id", "left_size", "right_id", "right_size", "score")


def near_miss_counts(remaining: DataFrame, bag: DataFrame, threshold: float, floors: list[float], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(score, pairs): how many of ``near_miss_edges`` lie between a floor (``threshold``, then those of ``floors`` above it, ascending) and the next; score is that floor."""
    t = float(threshold)
    own = keep(bag.join(remaining.select("form_id"), "form_id", "left_semi"))
    if few_fingerprints(own):
        return dense_counts(own, remaining, t, floors)
    floor = F.greatest(F.lit(t), *(F.when(F.col("score") >= x, F.lit(x)) for x in floors if x > t))
    return near_miss_edges(remaining, bag, threshold, keep).groupBy(floor.alias("score")).agg(F.count("*").alias("pairs"))


def _by_parts(packed: DataFrame, remaining: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    ids = lambda c: remaining.select(F.col("form_id").alias(c))
    pairs = keep(keep(packed_candidates(packed.where("kind is not null"), threshold)).join(ids("left_id"), "left_id", "left_semi").join(ids("right_id"), "right_id", "left_semi"))
    both = keep(pairs.select(F.explode(F.array("left_id", "right_id")).alias("form_id")).distinct())
    return packed_scores(pairs, keep(bags_of(packed, both)), keep)


def with_ties(edges: DataFrame, remaining: DataFrame, bag: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, counts: Callable[[DataFrame], DataFrame] | None = None, bags: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``edges`` with tie_rank: the place, in the left form, of the first fingerprint that both have, rarest first; 0 where no other edge has its left form and score.

    At a threshold above 0 that fingerprint lies in both prefixes. ``counts`` gives (fp, df) and ``bags`` the bags of
    the forms they are given, where there is a shorter way than by all bags.
    """
    tied = keep(edges.withColumn("_n", F.count("*").over(Window.partitionBy("left_id", "score"))).where("_n > 1").drop("_n"))
    if tied.isEmpty():
        return edges.withColumn("tie_rank", F.lit(0).cast("bigint"))
    ids = remaining.select("form_id")
    df = keep(counts(ids) if counts else fingerprint_df(bag.join(ids, "form_id", "left_semi")))
    order = unsigned_order(F.col("fp"), dict(bag.dtypes)["fp"])
    wanted = keep(tied.select(F.explode(F.array("left_id", "right_id")).alias("form_id")).distinct())
    some = keep((bags(wanted) if bags else bag.join(wanted, "form_id", "left_semi")).join(df, "fp").select("form_id", "fp", (F.row_number().over(Window.partitionBy("form_id").orderBy("df", order)) - 1).cast("bigint").alias("position")))
    left = tied.select("left_id", "right_id").join(some.withColumnRenamed("form_id", "left_id"), "left_id")
    ties = left.join(some.select(F.col("form_id").alias("right_id"), "fp"), ["right_id", "fp"]).groupBy("left_id", "right_id").agg(F.min("position").alias("tie_rank"))
    return edges.join(keep(ties), ["left_id", "right_id"], "left").withColumn("tie_rank", F.coalesce("tie_rank", F.lit(0).cast("bigint")))
