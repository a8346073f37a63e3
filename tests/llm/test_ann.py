import numpy as np

from kinsieve.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)


def brute(rows, k=10):
    """rows: (vec_id, vector) that are valid."""
    out = {}
    for q, v in rows:
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = d[:k]
    return out


def test_recall_on_several_shards(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 24))
    x = (centers[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    df = table(spark, x)
    rows = ann.nearest(df, df.where("vec_id % 50 = 0"), shard=500, most=500).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    d = np.sqrt(((x[::50, None, :].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(2))
    hit = 0
    for k, q in enumerate(range(0, 1500, 50)):
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, _, v in found]
        assert all(abs(s - d[k, v]) < 1e-9 for _, s, v in found) and [s for _, s, _ in found] == sorted(s for _, s, _ in found)
        d[k, q] = np.inf
        hit += len(set(np.argsort(d[k], kind="stable")[:10].tolist()) & {v for _, _, v in found})
    assert hit >= 0.95 * 300


def test_copies_ties_and_few_rows(spark):
    x = [[1, 0], [1, 0], [1, 0], [2, 0], [0, 1]] + [[5, 5]] * 40
    df = table(spark, x)
    want = brute(list(enumerate(x)))
    rows = ann.nearest(df, df.where("vec_id in (0, 2, 30)")).collect()
    for q in (0, 2, 30):
        assert [(r.score, r.vec_id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == want[q]
    few = table(spark, [[1, 0], [0, 1], [3, 3]])
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_odd_rows(spark):
    x = [None, [], [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 1], [1, 2], [1, 2, 3], [2, 2, 3]]
    df = table(spark, x).union(spark.createDataFrame([(None, [1.0, 1.0], 0), (7, [1.0, 2.0], 1)], SCHEMA))
    rows = ann.nearest(df, df).collect()
    assert sorted((r.query_id, r.vec_id) for r in rows) == [(6, 7), (7, 6), (8, 9), (9, 8)]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 6"), df.where("vec_id = 6")).collect() == []


def test_shards_grow_before_their_number_does():
    assert [ann.shards_for(n, 8) for n in (0, 1, 4096, 10_000, 65_536, 1_000_000, 2_000_000, 10**9)] == [1, 1, 1, 2, 16, 16, 31, 15259]


def test_large_shard_keeps_its_recall():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 32))
    x = centers[rng.integers(0, 60, 9000)] + 0.5 * rng.normal(size=(9000, 32))
    shard = ann.Shard(x, [[i] for i in range(9000)])
    assert shard.beam == int(64 * (9000 / 4096) ** 0.5)
    got = {}
    for own, c, _ in shard.search(x[:100], list(range(100))):
        got.setdefault(own, []).append(c)
    d = ((x[:100, None] - x[None]) ** 2).sum(2)
    hit = sum(len({c for c in np.argsort(d[i])[:11].tolist() if c != i} & set(got[i])) for i in range(100))
    assert hit >= 950


def test_clashing_columns_and_layouts(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    df = table(spark, np.round(rng.normal(size=(300, 6)), 1).astype(np.float32))
    wide = df.select("*", *(F.lit(3).alias(c) for c in ("shard", "dim", "kind", "vector", "ids", "rank", "score", "query_id", "part")))
    want = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 30 = 0")).collect()))
    assert len(want) == 100
    for parts in (1, 7):
        some = wide.repartition(parts)
        assert sorted(map(tuple, ann.nearest(some, some.where("vec_id % 30 = 0")).collect())) == want
