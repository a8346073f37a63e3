import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinsieve.llm import packing
from llm.helpers import DOCS, ODD, docs

WORDS = ["alpha", "beta", "gamma", "delta", "x1", "don't", "é"]


def check(spark, df, window):
    library = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(df, window).collect()
    want = sorted((str(r.doc_id), tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in df.select("doc_id", "text").collect())
    by_doc = {}
    for r in rows:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    for (doc, ids) in want:
        if sum(w[0] == doc for w in want) > 1:
            continue
        pieces = sorted(by_doc[doc, len(ids)], key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = []
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        lengths.append(at)
    return lengths


def test_pieces_and_sequences(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([3, 5, 8, 40, 41, 60, 150]))) for _ in range(300)]
    lengths = check(spark, docs(spark, texts, extra=True, parts=5), 64)
    assert sum(64 - x for x in lengths) < 0.02 * sum(lengths)


def test_odd_rows(spark):
    check(spark, docs(spark, [*ODD, "a <|endoftext|> b  <|endoftext|>", (None, "x"), (1, "twice"), (1, "twice")]), 1024)
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("counts", [{1: 100}, {1023: 5}, {512: 7}, {300: 10, 424: 10}, {5: 1000, 700: 3, 1000: 40, 24: 40}, {}])
def test_plans_use_every_rest_once(counts):
    hist = np.zeros(1024, np.int64)
    for k, n in counts.items():
        hist[k] = n
    used = np.zeros(1024, np.int64)
    for repeats, combo in packing.plan(hist):
        assert sum(k * v for k, v in combo) <= 1024
        for k, v in combo:
            used[k] += repeats * v
    assert (used == hist).all()


def test_combinations_fill_the_window():
    hist = np.zeros(1024, np.int64)
    hist[[100, 200, 724, 512, 924, 341, 342]] = 5
    for combo in packing.combinations(hist, 1024):
        assert sum(k * v for k, v in combo.items()) == 1024 and all(hist[k] for k in combo)


def test_both_libraries_agree():
    e = packing.encoder(packing.default_vocabulary())
    assert e.fast is not None
    for t in [x for x in ODD if x is not None] + ["a \x1cb\x1d  c", "  lead", "trail  ", "x y 　z", "a\n\n b\t\tc", "\u0085q \x0b r"]:
        assert np.frombuffer(e([t])[0], "<u4").tolist() == e.library.encode(t, add_special_tokens=False).ids


def nnls(a, b):
    """Reference: the active-set method on normal equations."""
    m = a.shape[1]
    x, active = np.zeros(m), np.zeros(m, bool)
    for _ in range(10 * m):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if w.max(initial=-np.inf) <= 1e-9:
            break
        active[int(w.argmax())] = True
        while True:
            s = np.zeros(m)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 1e-12)
            if not bad.any():
                x = s
                break
            step = min(x[k] / (x[k] - s[k]) for k in np.flatnonzero(bad))
            x = x + step * (s - x)
            active &= x > 1e-12
    return x


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_equal_the_reference(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(64, np.int64)
    hist[rng.choice(np.arange(1, 64), 20, replace=False)] = rng.integers(1, 200, 20)
    columns = packing.combinations(hist, 64)
    a = np.zeros((64, len(columns)))
    for j, c in enumerate(columns):
        for k, v in c.items():
            a[k, j] = v
    want = ((a @ nnls(a, hist.astype(float)) - hist) ** 2).sum()
    x = packing.solve(columns, hist, 3000)
    assert (x >= 0).all() and ((a @ x - hist) ** 2).sum() <= want * 1.01 + 1
