import re

from kinsieve.llm import licenses
from llm.helpers import DOCS, ODD, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split(" "))] == phrase.split(" ")]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "Released Under the MIT License.", "under the mit license under the mit\nLICENSE under the-mit+license x", "CC-BY-NC 4.0 and cc by  nc", "apache license version 2.0 Apache License, Version 2", "cc by",
    "under the Kmit license K", "under the mit licenses", "Kby cc by nc", "cc by nc " * 300, "x " * 50 + "cc by nc by nc",
]


def test_base_equals_brute_force(spark):
    df = docs(spark, [*TEXTS, *ODD, (None, "cc by nc"), (1, "cc by nc")], extra=True)
    texts = [(r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(texts, key=key)


def test_templates_with_changed_words(spark):
    text, label = next(t for t in licenses.TEMPLATES if t[1] == "mit-text")
    w = text.split(" ")
    texts = [text, " ".join([*w[:8], "really", *w[8:]]).upper(), " ".join([*w[:6], *w[8:]]), " ".join(w[:5]), "pre " * 30 + text + " post" * 5]
    rows = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [label in rows[i].labels.split(",") for i in range(5)] == [True, True, True, False, True]
    assert rows[0].score == 1.0 and 0.5 <= rows[2].score < 1 and rows[3].score == 0.0 and rows[0].n_base == 0
    assert rows[4].spans.startswith("000000030:")


def test_scattered_hits_are_no_copy(spark):
    """Half of a template's words, each three on a neighbouring diagonal and far from the next, with other words between them."""
    text = next(t for t, label in licenses.TEMPLATES if label == "mit-whole")
    w = text.split(" ")
    scattered = " ".join(" ".join(w[i : i + 4]) + " " + " ".join(f"z{i}{k}" for k in range(9)) for i in range(0, len(w), 6))
    labels = [set(filter(None, r.labels.split(","))) for r in sorted(licenses.scan(docs(spark, [scattered, text])).collect(), key=lambda r: r.doc_id)]
    assert "mit-whole" not in labels[0] and "mit-whole" in labels[1]


def test_equal_rows_come_back_as_often(spark):
    df = spark.createDataFrame([(1, "cc by nc")] * 3 + [(1, "cc by"), (None, None), (None, None), (2, "cc by nc")], "doc_id bigint, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_base) for r in licenses.scan(df).collect())
    assert got == [("1", 2, 0), ("1", 3, 1), ("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("None", 0, 0), ("None", 0, 0)]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(docs(spark, TEXTS))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
