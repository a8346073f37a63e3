import random
import zlib

import numpy as np

from kinsieve.llm import toxicity
from llm.helpers import DOCS, ODD, docs

LABELS = "doc_id bigint, quality int, toxic int"


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def corpus(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(20, 60))]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgish", "zorgly", "idiot", "blart"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, y))
    return rows, labels


def test_held_out_quality(spark):
    rows, labels = corpus()
    out = toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = {r.doc_id: r for r in out if r.held_out}
    assert set(held) == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    y = np.array([labels[i][2] for i in held])
    assert auc(np.array([r.score for r in held.values()]), y) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_labels_of_held_out_rows_have_no_effect(spark):
    rows, labels = corpus(300)
    df = spark.createDataFrame(rows, DOCS)
    other = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.score(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, other))
    assert a == b


def test_odd_rows(spark):
    df = docs(spark, [*ODD, (None, "you idiot"), (1, "twice")], extra=True)
    none = toxicity.score(df, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(ODD) + 2 and {r.score for r in none} == {0.0}
    some = toxicity.score(df, spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (4, 1, None)], LABELS)).collect()
    assert {r.score for r in some} == {1.0}
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_isotonic():
    at, value = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.5, 4.0]


def test_features_have_names():
    f = toxicity.Features({"idiot": 3.0, "zorg*": 2.5})("You IDIOT, zorgish 1d1ot!! why?")
    got = dict(zip(toxicity.NAMES, f, strict=True))
    assert got["hits"] == 1 and got["begins"] == 2.5 and got["near_second"] == 1 and got["caps_words"] > 0 and got["runs"] > 0 and got["masked"] > 0
    assert len(toxicity.Features({})("")) == len(toxicity.NAMES)


def test_isotonic_equals_brute_force():
    """The fit at i is the greatest, over starts a <= i, of the least mean, over ends b >= i, of a..b."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        score, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        level = np.unique(score)
        mean = lambda a, b: y[(score >= a) & (score <= b)].mean()  # noqa: E731,B023
        want = [max(min(mean(a, b) for b in level if b >= v) for a in level if a <= v) for v in level]
        at, value = toxicity.isotonic(score, y)
        ends = [np.flatnonzero(np.isclose(want, v))[-1] for v in value]
        assert np.allclose(np.unique(np.round(want, 12)), value)
        assert (np.diff(at) > 0).all() and all(at[k] <= level[e] for k, e in enumerate(ends))


def test_first_split_equals_exhaustive_search():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, (200, 3)).astype(float)
    y = ((x[:, 1] > 11) ^ (rng.random(200) < 0.1)).astype(float)
    trees = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    best = max(((g[x[:, j] < c].sum() ** 2 / (h[x[:, j] < c].sum() + 1) + g[x[:, j] >= c].sum() ** 2 / (h[x[:, j] >= c].sum() + 1)), j, c) for j in range(3) for c in np.unique(x[:, j])[1:] if h[x[:, j] < c].sum() >= 1.25 and h[x[:, j] >= c].sum() >= 1.25)
    low = x[:, best[1]] < best[2]
    want = np.where(low, g[low].sum() / (h[low].sum() + 1), g[~low].sum() / (h[~low].sum() + 1)) * 0.1 + np.log(p / (1 - p))
    assert np.allclose(trees.predict(x), want)


def test_few_labels_and_repeated_ids(spark):
    rows, labels = corpus(60)
    used = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic, clean = [i for i in used if labels[i][2]][:2], [i for i in used if not labels[i][2]][:2]
    few = spark.createDataFrame([labels[i] for i in toxic + clean], LABELS)
    assert len(toxic) == 2
    out = toxicity.score(spark.createDataFrame(rows, DOCS), few).collect()
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 60
    twice = spark.createDataFrame([*rows, (used[0], "another text " * 30, "en", "s", 0), (used[1], None, "en", "s", 0)], DOCS)
    every = spark.createDataFrame(labels, LABELS)
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.score(twice.repartition(n), every).collect()) for n in (1, 5))
    assert a == b and len(a) == 62
