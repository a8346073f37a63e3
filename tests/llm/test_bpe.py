import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinsieve.llm import bpe, bpe_codec, token_counts
from llm.helpers import DOCS, ODD, docs

PATH = bpe.default_vocabulary()
HARD = ["naïve Σας ΑΣ İstanbul K kelvin ﬁ", "a<|endoftext|>b <|startoftext|> <|endoftext|", "don't we'll 'S x'Re ''s", "ab1234 -- ... \x1c a\x1db \x85 q", "́abc é", "Ǆ ǅ ŉ ſ ß", "$1,000.00!!! (x)"]


@pytest.fixture(scope="module")
def m():
    return bpe.model(PATH)


@pytest.mark.parametrize("text", HARD + [t for t in ODD if t is not None])
def test_equals_library(m, text):
    want = m.library.encode(text, add_special_tokens=False).ids
    assert m.encode(text) == want
    assert m.decode(want) == m.library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abth e.,'sé1İΣ<|>", max_size=60))
def test_random_texts(text):
    m = bpe.model(PATH)
    assert m.encode(text) == m.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*HARD, "Hello, wonderful world! it's 42 thandhesh"])
def test_prefix_counts(m, text):
    assert m.prefix_counts(text) == [len(m.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


MARKED = ["e\u0301a\u0300b cafe\u0301s x\u0301\u0323y", "ᄒ\u1161\u11ab국어 각\u11a8", "हिन्दी की किताब", "日本語の文章，一二３", "ไทยภาษา", "a<|endoftext|>é!!<|endoftext|>日<|endoftex", "s 's'd'll's x'", "İstanbul ΑΣ", "א\u05bcב", "😂😂😂😂❤️👍🏽🇺🇸🇺🇸"]


@pytest.mark.parametrize("text", MARKED)
def test_prefix_counts_of_composed_text(m, text):
    assert m.prefix_counts(text) == [len(m.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


@settings(max_examples=120, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="abthe e.,'sé1İΣ<|>\u0301\u0323日本ᄒ\u1161\u11ab", max_size=40))
def test_prefix_counts_of_random_texts(text):
    m = bpe.model(PATH)
    assert m.prefix_counts(text) == [len(m.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["the and that with " * 25_000, "thandhesh" * 11_000, "日本語の文章" * 17_000, "'" * 100_000, "e\u0301" * 50_000, "ᄒ\u1161\u11ab" * 33_000, "😂" * 100_000])
def test_prefix_counts_of_very_long_texts(m, text):
    began = time.process_time()
    counts = m.prefix_counts(text)
    assert time.process_time() - began < 60
    for k in (1, 2, 1000, 30_001):
        assert counts[k] == len(m.library.encode(text[:k], add_special_tokens=False).ids)
    assert len(counts) == len(text) + 1 and counts[-1] == len(m.encode(text))


@pytest.mark.parametrize("limit", [0, 1, 3, 7, 20])
def test_cut_is_the_longest_prefix_within_the_limit(m, limit):
    count = token_counts.Counter(PATH, limit)
    for text in [*HARD, *MARKED, "", "  ", "one  two", "thandhesh " * 9]:
        counts = m.prefix_counts(text)
        assert count(text) == (counts[-1], counts[-1] > limit, max((k for k, c in enumerate(counts) if c <= limit and (counts[-1] > limit or k == len(text))), default=0))


def test_budget():
    text = "the quick brown fox jumps over the lazy dog"
    counts = token_counts.prefix_counts(text)
    m = bpe.model(PATH)
    for budget in range(12):
        k = counts.within(budget)
        assert len(m.encode(text[:k])) <= budget
        assert k == len(text) or len(m.encode(text[: k + 1])) > budget
    assert counts.total() == len(m.encode(text))


def test_queries(spark, m):
    df = docs(spark, [*HARD, *ODD, (None, "x"), (1, "twice")], extra=True)
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = []
    for i, t in texts:
        ids = m.library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe_codec.round_trip(df).collect()), key=key) == sorted(want, key=key)
    got = sorted((tuple(r)[:4] for r in token_counts.token_counts(df, limit=20).collect()), key=key)
    assert got == sorted([(i, len(t.encode()), w[1], w[1] > 20) for (i, t), w in zip(texts, want, strict=True)], key=key)
    back = bpe_codec.decode(bpe_codec.encode(df)).collect()
    assert len(back) == len(texts)
    assert token_counts.with_prefix_counts(df, step=2).count() == len(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert bpe_codec.round_trip(df).collect() == token_counts.token_counts(df).collect() == []


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    m = bpe.WordBpe(PATH)
    text = "some words that overflow the very small caches some words"
    assert m.encode(text) == m.library.encode(text, add_special_tokens=False).ids
    assert len(m._words) <= 3 and len(m._words.old) <= 3 and len(m._pairs) <= 3
