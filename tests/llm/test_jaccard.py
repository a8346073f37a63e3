import random
from collections import defaultdict

import numpy as np
import pytest

from kinsieve.llm import jaccard, shingles
from llm.helpers import DOCS, ODD, docs


def brute(texts):
    sets = {i: set(shingles.sequence(t or "").tolist()) for i, t in texts}
    links, root = defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def family(rng, n, words=120, edits=1):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(2)
    texts = family(rng, 25) + family(rng, 12, 40, 2) + family(rng, 10, 60, 3) + [" ".join(f"u{rng.randrange(9999)}" for _ in range(50)) for _ in range(40)]
    texts += [texts[0]] * 6 + [texts[80]] * 3 + [t.upper() for t in texts[30:33]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = list(enumerate(corpus()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similarity_join(docs(spark, texts, extra=True)).collect()}
    assert got == brute(texts)


def test_keep_one(spark):
    texts = corpus()
    df = docs(spark, texts)
    want = {i for i, (c, _) in brute(list(enumerate(texts))).items() if c == i}
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_odd_rows(spark):
    df = docs(spark, [*ODD, "ONE", (None, "one"), (None, None), (3, "one")], extra=True)
    out = jaccard.similarity_join(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) + 2 and by[None].class_id is None and by[None].n_links == 0
    assert by[12].class_id == 3 and by[12].n_links == 1 and by[3].n_links == 1
    assert by[0].n_links == by[1].n_links == by[2].n_links == 0 and by[11].class_id == 10
    kept = jaccard.keep_one(df).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and not any(r.doc_id in (11, 12) for r in kept)
    assert jaccard.similarity_join(spark.createDataFrame([], DOCS)).collect() == []


def test_pruning_keeps_what_may_reach_the_threshold():
    assert all(jaccard.least_matches(n) <= 0.8 * n for n in range(jaccard.STEP, 253, jaccard.STEP))
    assert jaccard.least_matches(252) > 0.5 * 252  # and drops what can't
    rng = np.random.default_rng(1)
    dropped = sum((rng.random(252) < 0.8)[:n].sum() < jaccard.least_matches(n) for _ in range(400) for n in range(36, 253, 36))
    assert dropped == 0


def test_minhash_in_parts_is_the_same():
    v = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 9000, dtype=np.uint64))
    whole = ((v[None, :] * jaccard._A[:, None] + jaccard._B[:, None]).min(1) >> np.uint64(32)).astype(np.uint32)
    assert (jaccard.minhash(v) == whole).all()
