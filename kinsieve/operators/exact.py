"""Exact clones: equal bags of one kind, split by whether identifiers agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TYPE_1, TYPE_2
from .bags import bag_digest, trace_digest


def form_keys(forms: DataFrame, bag: DataFrame) -> DataFrame:
    """(form_id, kind, bag_key, bag_size, trace_key) of forms whose bag isn't empty."""
    own = forms.select(F.col("id").alias("form_id"), "kind", trace_digest(F.col("ident_trace")).alias("trace_key"))
    return bag_digest(bag).join(own, "form_id")


def exact_groups(keys: DataFrame) -> DataFrame:
    """(bag_key, kind, forms, leftover): groups of two or more, and whether some trace stands alone."""
    traces = keys.groupBy("bag_key", "kind", "trace_key").agg(F.count("*").alias("n"))
    return traces.groupBy("bag_key", "kind").agg(F.sum("n").alias("forms"), F.max((F.col("n") == 1).cast("int")).alias("leftover")).where("forms >= 2")


def exact_members(keys: DataFrame) -> DataFrame:
    """(finding_key, clone_type, form_id).

    Each trace with two or more forms is a type-1 finding. If a trace of the group stands alone, a type-2
    finding covers the whole group.
    """
    traces = keys.groupBy("bag_key", "kind", "trace_key").agg(F.count("*").alias("n")).where("n >= 2")
    one = keys.join(traces.select("bag_key", "kind", "trace_key"), ["bag_key", "kind", "trace_key"], "left_semi")
    two = keys.join(exact_groups(keys).where("leftover = 1").select("bag_key", "kind"), ["bag_key", "kind"], "left_semi")
    key = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    return one.select(key(F.lit(TYPE_1), "kind", "bag_key", "trace_key").alias("finding_key"), F.lit(TYPE_1).alias("clone_type"), "form_id").union(
        two.select(key(F.lit(TYPE_2), "kind", "bag_key").alias("finding_key"), F.lit(TYPE_2).alias("clone_type"), "form_id")
    )


def claimed(keys: DataFrame) -> DataFrame:
    """(form_id) of all forms in exact findings: every form of a group of two or more is in one."""
    return keys.join(exact_groups(keys).select("bag_key", "kind"), ["bag_key", "kind"], "left_semi").select("form_id")


def unclaimed(keys: DataFrame) -> DataFrame:
    """(form_id, kind, bag_size) of forms that go on to near-miss matching."""
    return keys.join(claimed(keys), "form_id", "left_anti").select("form_id", "kind", "bag_size")
