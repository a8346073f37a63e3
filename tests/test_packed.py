"""Packed bags: whole results from parts, blocks and groups, and few candidates."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.operators import bags, dense, exact, near, packed
from kinsieve.plans.session import materialized
from kinsieve.schema import PRODUCTION
from kinsieve.sources.tables import text_forms


def texts(rng, n, vocabulary=400):
    """Texts of all lengths; common words stand often in each, and some texts are edited copies."""
    out = []
    for _ in range(n):
        w = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.choice([3, 10, 40, 130, 300, 900]))]
        out.append(w)
    for w in rng.sample(out, n // 2):
        out.append([f"x{rng.randrange(50)}" if rng.random() < rng.choice([0.02, 0.07, 0.1]) else x for x in w])
    return [" ".join(w) for w in out]


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(bags_, t):
    size = {k: sum(b.values()) for k, b in bags_.items()}
    return {(x, y): s for x in bags_ for y in bags_ if (size[x], x) < (size[y], y) and bags_[x] & bags_[y] and t <= (s := jaccard(bags_[x], bags_[y])) < 1}


@pytest.mark.parametrize("t", [0.5, 0.7, 0.85, 1.0])
def test_parts_find_what_brute_force_finds(spark, t):
    said = [*texts(random.Random(int(100 * t)), 80), "", None, "Word word; WORD", "word word other"]
    rows = spark.createDataFrame(list(enumerate(said)), "id bigint, text string").repartition(3)
    forms, bag = text_forms(rows, "id", "text", "t")
    rest = exact.unclaimed(exact.form_keys(forms, bag))
    whole = packed.packed_texts(rows, "id", "text", F.lit(PRODUCTION))
    ids = {r.form_id for r in rest.collect()}
    want = brute({k: Counter((said[k] or "").lower().replace(";", "").split()) for k in ids}, t)
    for given in (whole, None):  # packed in the row, and from (form_id, fp, cnt)
        got = near.near_miss_edges(rest, bag, t, materialized, given).collect()
        assert {(r.left_id, r.right_id): r.score for r in got} == want and len(got) == len(want)
    assert t == 1.0 or want


@pytest.mark.parametrize("t", [0.5, 0.85])
def test_blocks_of_hot_occurrences_lose_no_pair(monkeypatch, t):
    monkeypatch.setattr(packed, "BLOCK", 7)
    rng = random.Random(3)
    held = list({frozenset(c.items()): c for c in (Counter(x.split()) for x in texts(rng, 60, 12))}.values())  # equal bags are exact findings
    data = []
    for c in held:
        fp = np.array([int(packed.digest(w.encode())[:15], 16) for w in c], np.uint64)
        order = np.argsort(fp)
        data.append(fp[order].tobytes() + np.array(list(c.values()), np.uint32)[order].tobytes())
    rare = np.full(packed.SLOTS, 40, np.uint8)
    rows = packed.postings(np.arange(len(data)), ["p"] * len(data), [packed.digest(x) for x in data], data, rare, t)
    got = {(int(x), int(y)) for a, _, b, _ in packed.met(rows, t) for x, y in zip(a, b, strict=True)}
    want = set(brute(dict(enumerate(held)), t))
    assert got >= want and want


def test_unlike_texts_that_share_their_rarest_words_are_no_candidates(spark):
    """A join on keys makes a row of each such pair before it scores any."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, " ".join(["shared", *(f"w{rng.randrange(3000)}" for _ in range(200))])) for k in range(300)], "id bigint, text string")
    whole = packed.packed_texts(rows, "id", "text", F.lit(PRODUCTION))
    assert packed.packed_candidates(whole, 0.85).count() == 0
    forms, bag = text_forms(rows, "id", "text", "t")
    keys = bags.prefix_keys(bag, 0.85)
    assert keys.alias("a").join(keys.alias("b"), (F.col("a.fp") == F.col("b.fp")) & (F.col("a.form_id") < F.col("b.form_id"))).count() > 1000


def test_groups_of_many_pairs_are_cut(spark, monkeypatch):
    monkeypatch.setattr(packed, "GROUP", 5)
    said = [" ".join(f"w{k}" for k in range(n, n + 60)) for n in range(12)]
    rows = spark.createDataFrame(list(enumerate(said)), "id bigint, text string")
    whole = packed.packed_texts(rows, "id", "text", F.lit(PRODUCTION))
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "left_id bigint, right_id bigint")
    got = {(r.left_id, r.right_id): (r.left_size, r.right_size, r.score) for r in packed.packed_scores(pairs, packed.bags_of(whole, spark.range(12).withColumnRenamed("id", "form_id")), materialized).collect()}
    assert got == {(a, b): (60, 60, (60 - b + a) / (60 + b - a)) for a in range(12) for b in range(a + 1, 12)}


@pytest.mark.parametrize("t", [0.0, 0.5, 0.9])
def test_bags_of_few_fingerprints_block_by_block(spark, monkeypatch, t):
    monkeypatch.setattr(dense, "BLOCK", 9)
    rng = random.Random(7)
    held = {k: Counter(rng.choices("abcde", [9, 5, 3, 1, 1], k=rng.randint(1, 30))) for k in range(70)}
    kinds = {k: rng.choice("pq") for k in held}
    bag = spark.createDataFrame([(k, fp, n) for k, b in held.items() for fp, n in b.items()], "form_id bigint, fp string, cnt bigint")
    rest = spark.createDataFrame([(k, kinds[k], sum(b.values())) for k, b in held.items()], "form_id bigint, kind string, bag_size bigint")
    got = near.near_miss_edges(rest, bag, t, materialized).collect()
    want = {p: s for p, s in brute(held, t).items() if kinds[p[0]] == kinds[p[1]]}
    assert {(r.left_id, r.right_id): r.score for r in got} == want and len(got) == len(want)
    everything = near.all_pairs(bag, materialized).collect()
    assert len(everything) == sum(bool(held[a] & held[b]) for a in held for b in held if a < b)


def test_texts_end_their_tokens():
    import pyarrow as pa

    spelled, lower, of = packed.tokens(pa.array(["skipped", "ab", "CD é9", None, "", "cd", "ab"]).slice(1))
    assert of.tolist() == [0, 1, 1, 4, 5]
    assert lower[1] == lower[3] and spelled[1] != spelled[3] and spelled[0] == spelled[4] and lower[0] == lower[4]


def test_counts_of_texts_are_those_of_their_bags(spark):
    from kinsieve.sources.tables import text_counts

    rows = spark.createDataFrame(list(enumerate([*texts(random.Random(9), 30), None, "A a b"])), "id bigint, text string").repartition(3)
    _, bag = text_forms(rows, "id", "text", "t")
    ids = spark.range(0, 46, 2).withColumnRenamed("id", "form_id")
    want = bags.fingerprint_df(bag.join(ids, "form_id", "left_semi"))
    assert sorted(text_counts(rows, "id", "text", ids).collect()) == sorted(want.collect())


def test_ties_are_ranked_where_they_decide(spark):
    held = {1: "a b c d", 2: "a b c e", 3: "b c d e", 4: "z b"}
    bag = spark.createDataFrame([(k, w, 1) for k, x in held.items() for w in x.split()], "form_id bigint, fp string, cnt bigint")
    rest = spark.createDataFrame([(k,) for k in held], "form_id bigint")
    edges = spark.createDataFrame([(1, 4, 2, 4, 0.6), (1, 4, 3, 4, 0.6), (2, 4, 3, 4, 0.6)], "left_id bigint, left_size bigint, right_id bigint, right_size bigint, score double")
    got = {(r.left_id, r.right_id): r.tie_rank for r in near.with_ties(edges, rest, bag, materialized).collect()}
    assert got == {(1, 2): 0, (1, 3): 1, (2, 3): 0}  # of 1: a and d are in two forms, c in three, b in all


@pytest.mark.parametrize("t", [0.1, 0.25, 0.4])
def test_sketches_of_blocks_find_what_brute_force_finds(spark, monkeypatch, t):
    from kinsieve.operators import sketch

    monkeypatch.setattr(sketch, "BLOCK", 40)
    rng = random.Random(int(100 * t))
    rows, said = [], {}
    for k, text in enumerate([*texts(rng, 60, 1500), "", None, "Word word; WORD", "word word other"]):
        words = (text or "").replace(";", "").split()
        cut = len(words) // 2
        for turn, (role, part) in enumerate([("user", words[:cut]), (None if k % 7 == 0 else "bot", words[cut:])]):
            rows.append((k, turn, role, " ".join(part) if text is not None else None))
            said.setdefault(k, []).extend(f"{role}:{w}".lower() for w in part)
    turns = spark.createDataFrame([*rows, (None, 0, "user", "word word other")], "id bigint, turn int, role string, text string").repartition(3)
    whole = materialized(packed.packed_turns(turns, "id", "role", "text", F.lit(PRODUCTION)))
    rest = materialized(exact.unclaimed(whole.drop("bag")))
    ids = {r.form_id for r in rest.collect()}
    want = brute({k: Counter(said[k]) for k in ids}, t)
    got = near.near_miss_edges(rest, None, t, materialized, whole).collect()
    assert {(r.left_id, r.right_id): r.score for r in got} == want and len(got) == len(want) and want
    plan = near.near_miss_edges(rest, None, t, materialized, whole)._jdf.queryExecution().executedPlan().toString()
    assert "left_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)  # pairs aren't shuffled


@pytest.mark.parametrize("t", [0.0, 0.5, 0.9])
def test_pairs_are_counted_where_blocks_meet(spark, monkeypatch, t):
    monkeypatch.setattr(dense, "BLOCK", 20)
    rng = random.Random(11)
    held = {k: Counter({x: n for x in "abcde" if (n := rng.randrange(9))}) or Counter("a") for k in range(70)}
    bag = spark.createDataFrame([(k, x, n) for k, c in held.items() for x, n in c.items()], "form_id bigint, fp string, cnt bigint")
    rest = bags.bag_sizes(bag).withColumn("kind", F.lit(PRODUCTION))
    size = {k: sum(c.values()) for k, c in held.items()}
    scores = [s for x in held for y in held if (size[x], x) < (size[y], y) and held[x] & held[y] and t <= (s := jaccard(held[x], held[y])) < 1]
    want = Counter(max(x for x in (t, 0.85, 0.95) if x <= s and x >= t) for s in scores)
    counted = near.near_miss_counts(rest, bag, t, [0.85, 0.95], materialized)
    assert {r.score: r.pairs for r in counted.collect()} == want
    monkeypatch.setattr(near, "few_fingerprints", lambda bag: False)
    if t >= 0.5:
        assert {r.score: r.pairs for r in near.near_miss_counts(rest, bag, t, [0.85, 0.95], materialized).collect()} == want
