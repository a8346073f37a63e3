"""Bags in, findings out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinsieve.operators import bags, cluster, exact, near
from kinsieve.operators.components import connected_components
from kinsieve.plans.compare import compare, findings, ordered
from kinsieve.plans.session import materialized
from kinsieve.schema import BAG, FORMS


def tables(spark, forms):
    """forms: (bag, trace, kind) each; a bag is a list of keys or a dict key -> count."""
    rows, items = [], []
    for k, (bag, trace, kind) in enumerate(forms, 1):
        rows.append((k, "a.rs", f"f{k:02}", 1, 10, kind, 10, [trace]))
        items += [(k, fp, c) for fp, c in Counter(bag).items()]
    return spark.createDataFrame(rows, FORMS), spark.createDataFrame(items, BAG)


def found(spark, bags_, t, kinds=None, traces=None):
    n = len(bags_)
    forms = list(zip(bags_, traces or [f"t{k}" for k in range(n)], kinds or ["production"] * n, strict=True))
    out = {}
    for r in compare(*tables(spark, forms), t).collect():
        out.setdefault((r.finding_key, r.clone_type, r.tier, round(r.score, 6)), []).append((r.member_seq, r.form_id))
    return sorted((k[1], [m for _, m in sorted(v)], k[3], k[2]) for k, v in out.items())


def span(a, b):
    return list(range(a, b))


CASES = {
    "B1": ([[1, 2, 3]] * 2, 0.85, "xy", [("type_2", [1, 2], 1.0, "auto_refactor")]),
    "B2": ([[1, 2, 3]] * 3, 0.85, "xxy", [("type_1", [1, 2], 1.0, "auto_refactor"), ("type_2", [1, 2, 3], 1.0, "auto_refactor")]),
    "B3": ([[1, 2, 3]] * 4, 0.85, "aabc", [("type_1", [1, 2], 1.0, "auto_refactor"), ("type_2", [1, 2, 3, 4], 1.0, "auto_refactor")]),
    "B4": ([[1, 2, 3, 4, 5], [1, 2, 3, 4, 9]], 0.5, None, [("type_3", [1, 2], 0.666667, "advisory")]),
    "B5": ([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6]], 0.5, None, [("type_3", [1, 2, 3], 0.6, "advisory")]),
    "B6": ([[1, 2, 3, 4], [1, 2, 3, 5], [2, 3, 5, 6]], 0.5, None, [("type_3", [1, 2], 0.6, "advisory")]),
    "B7": ([span(0, 40), span(1, 41), span(2, 42)], 0.85, None, [("type_3", [1, 2, 3], 0.904762, "review_first")]),
    "B8": ([[1, 2, 3, 4, 100 + i] for i in range(16)], 0.5, None, [("type_3", span(1, 17), 0.666667, "advisory")]),
    "B9": ([{1: 94, 10: 3, 11: 3}, {1: 94, 10: 3, 12: 3}, {1: 10, 30: 45, 31: 45}], 0.85, None, [("type_3", [1, 2], 0.941748, "review_first")]),
    "B10": ([[1, 1000 + i] for i in range(40)], 0.85, None, []),
    "B12": ([{1: 2, 2: 1}, {1: 1, 2: 1}], 0.5, None, [("type_3", [1, 2], 0.666667, "advisory")]),
    "B13": ([[1, 2]] * 4, 0.85, "aabb", [("type_1", [1, 2], 1.0, "auto_refactor"), ("type_1", [3, 4], 1.0, "auto_refactor")]),
    "B14": ([[1, 2, 3, 4, 5]] * 2 + [[1, 2, 3, 4, 9]], 0.5, "aab", [("type_1", [1, 2], 1.0, "auto_refactor")]),
    "B15": ([span(0, 60), span(0, 33)], 0.55, None, [("type_3", [1, 2], 0.55, "advisory")]),
    "B16": ([[1, 2], [3, 4]], 0.0, None, []),
    "B17": ([[1, 2, 3], [1, 2, 3, 4]], 1.0, None, []),
    "B18": ([[], []], 0.5, None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_bag_cases(spark, name):
    bags_, t, traces, want = CASES[name]
    assert found(spark, bags_, t, traces=list(traces) if traces else None) == want


def test_kinds_never_mix(spark):
    assert found(spark, [[1, 2, 3]] * 2, 0.5, kinds=["production", "test"]) == []
    assert found(spark, [[1, 2, 3]] * 2, 0.85, kinds=["test"] * 2, traces=["x", "y"]) == [("type_2", [1, 2], 1.0, "auto_refactor")]


def test_threshold_is_validated(spark):
    with pytest.raises(ValueError, match="threshold"):
        compare(*tables(spark, [([1], "a", "production")]), 1.5)


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


@pytest.mark.parametrize("t", [0.0, 0.3, 0.5, 0.55, 0.85, 0.95, 1.0])
def test_prefix_join_finds_what_brute_force_finds(spark, t):
    rng = random.Random(int(t * 100))
    bags_ = [Counter(rng.choices(range(14), k=rng.randint(1, 12))) for _ in range(60)]
    bags_ += [Counter({k: c + (rng.random() < 0.15) for k, c in b.items()}) for b in bags_[:20]]
    forms, bag = tables(spark, [(b, "t", "production") for b in bags_])
    rest = exact.unclaimed(exact.form_keys(forms, bag))
    ids = sorted(r.form_id for r in rest.collect())
    got = {(r.left_id, r.right_id): r.score for r in near.near_miss_edges(rest, bag, t).collect()}
    size = {i: sum(bags_[i - 1].values()) for i in ids}
    want = {}
    for x in ids:
        for y in ids:
            if (size[x], x) < (size[y], y) and bags_[x - 1] & bags_[y - 1] and t <= (s := jaccard(bags_[x - 1], bags_[y - 1])) < 1:
                want[x, y] = s
    assert got == want


def test_unsigned_order_of_ties(spark):
    bag = spark.createDataFrame([(1, fp, 1) for fp in (5, -1, 1, -(1 << 63))], BAG)
    order = [r.fp for r in bags.prefix_keys(bag, 0.0).orderBy("position").collect()]
    assert order == [1, 5, -(1 << 63), -1]


def test_prefix_covers_its_mass(spark):
    bag = spark.createDataFrame([(1, 1, 94), (1, 10, 3), (1, 11, 3), (2, 1, 1)], BAG)
    rows = bags.prefix_keys(bag, 0.85).where("form_id = 1").collect()
    assert sum(r.cnt for r in rows) >= 16
    assert spark.range(1).select(bags.prefix_mass(F.lit(100), 0.85)).first()[0] == 16


def test_jaccard_of_maps(spark):
    row = spark.createDataFrame([({1: 2, 2: 1}, {1: 1, 2: 1}, {})], "a map<bigint,bigint>, b map<bigint,bigint>, e map<bigint,bigint>").select(near.jaccard_maps(F.col("a"), F.col("b")), near.jaccard_maps(F.col("e"), F.col("e"))).first()
    assert tuple(row) == (2 / 3, 0.0)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), materialized).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), materialized).count() == 0


def test_rounds_match_as_one_task_does(spark):
    rng = random.Random(5)
    rows = [(0, a, 1, rng.randrange(3), b, 1, rng.choice([0.5, 0.6, 0.7])) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "component bigint, left_id bigint, left_size bigint, tie_rank bigint, right_id bigint, right_size bigint, score double")
    stats = spark.createDataFrame([(0, 30, len(rows), 0.5, False)], "component bigint, forms bigint, edges bigint, score double, closed boolean")
    one = sorted(map(tuple, cluster.greedy_pairs(edges, stats, materialized).collect()))
    rounds = sorted(map(tuple, cluster.greedy_pairs(edges, stats, materialized, task_edges=1).collect()))
    assert one == rounds and one


def test_findings_in_order(spark):
    forms = [([1, 2, 3], "x", "production"), ([1, 2, 3], "x", "production"), ([1, 2, 3], "y", "production"), (span(10, 20), "a", "production"), (span(10, 19), "b", "production")]
    rows = ordered(findings(compare(*tables(spark, forms), 0.85))).collect()
    assert [(r.clone_type, len(r.members)) for r in rows] == [("type_1", 2), ("type_2", 3), ("type_3", 2)]


def test_empty_tables(spark):
    assert compare(spark.createDataFrame([], FORMS), spark.createDataFrame([], BAG), 0.85).count() == 0


def test_bag_of_array_counts_within_rows(spark):
    from kinsieve.operators.bags import bag_of_array, build_bag

    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["x"]), (4, None), (5, ["q"] * 500 + ["r"])], "id bigint, fps array<string>")
    want = build_bag(rows.selectExpr("id as form_id", "explode(fps) as fp"))
    assert sorted(bag_of_array(rows, "id", "fps").collect()) == sorted(want.collect())


def test_numbered_places_rows_by_ranges(spark):
    from pyspark.sql import functions as F

    from kinsieve.plans.compare import numbered

    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("x"), F.col("id")).repartition(7)
    got = numbered(rows, [F.desc("x"), F.asc("id")], "place", materialized).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501))
    assert [(-r.x, r.id) for r in got] == sorted((-r.x, r.id) for r in got)
    assert numbered(rows.limit(0), [F.desc("x")], "place", materialized).collect() == []


def test_bands_hold_every_window(spark):
    import math

    from pyspark.sql import functions as F

    from kinsieve.operators.near import size_band

    for t in (0.1, 0.5, 0.85, 0.99):
        sizes = spark.range(1, 400).select(F.col("id"), size_band(F.col("id"), t).alias("band"), size_band(F.col("id") / F.lit(t) + 1, t).alias("top")).collect()
        band = {r.id: r.band for r in sizes}
        for r in sizes:
            for large in range(r.id, min(399, math.floor(r.id / t + 1e-9)) + 1):
                assert r.band <= band[large] <= r.top


def test_materialized_lets_go_of_what_it_wrote(spark, monkeypatch):
    """A table that only its writing needs is free, with its shuffles, when garbage is collected after it was written."""
    import gc
    import weakref

    from kinsieve.plans import session

    kept, alive = [], []
    monkeypatch.setattr(session, "released", lambda _: (gc.collect(), alive.extend(x() is not None for x in kept)))

    def grouped():
        df = spark.range(10).groupBy("id").count()
        kept.append(weakref.ref(df))
        return df

    out = session.materialized(grouped())
    assert alive == [False] and out.count() == 10
