import re
from collections import Counter

import pytest

from kinsieve.llm import quality
from llm.helpers import DOCS, ODD, docs


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = [
    "a b c d e f g h i a b c d e f g h", "a " * 40, "l1 x\nl1 x\n \n \nl2", "# a | b <c>", "a b c d e f g h", "q w e r t y u i q w e r t y u i q w e r t y u i o",
    "a b c a b c a b c a b c", "w\x0bx\x0cy\rz v",
]


@pytest.mark.parametrize("text", TEXTS + [t for t in ODD if t is not None])
def test_counts_equal_brute_force(text):
    assert quality.features(text)[:5] == brute(text)


def test_on_documents_and_thresholds(spark):
    clean = [" ".join(f"w{(i * 7 + k * 13) % 997}" for k in range(60)) for i in range(150)]
    junk = [" ".join(f"w{(i * 5 + k * 11) % 997}***" for k in range(60)) for i in range(10)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + junk)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i].kept and not out[i].base_failed for i in range(150))
    assert not any(out[i].kept or out[i].base_failed for i in range(150, 160))


def test_odd_rows(spark):
    df = docs(spark, [*ODD, (None, "x y"), (3, "again")], extra=True)
    out = quality.quality_rules(df).collect()
    assert len(out) == len(ODD) + 2
    by = {r.doc_id: r for r in out if r.doc_id != 3}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].base_failed and not by[0].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def test_sketches_merge_in_any_order(spark):
    one = spark.createDataFrame([("m", b, n) for b, n in ((1, 3), (5, 2), (9, 9))], "metric string, bucket bigint, n bigint")
    from pyspark.sql import functions as F

    rows = one.select(F.explode(F.array(*(F.lit(m) for m in quality.METRICS))).alias("metric"), "bucket", "n")
    a, b = (sorted(quality.quartiles(x, []).collect()) for x in (rows.union(rows), rows.union(rows).orderBy(F.desc("bucket"))))
    assert a == b and {r["rows"] for r in a} == {28} and {(r.q1, r.q3) for r in a} == {(5000, 9000)}


def test_buckets_are_narrow_and_in_order(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 127, 128, 129, 255, 256, 258, 1000, 1008, 999_999, 10**6, 10**12, 10**12 + 2**33]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", quality.bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r.b for r in rows[:6]] == values[:6]
    assert all(x.b <= y.b and (x.b < y.b) == ((y.v >> max(0, y.v.bit_length() - quality.DIGITS)) << max(0, y.v.bit_length() - quality.DIGITS) > x.v) for x, y in zip(rows[:-1], rows[1:], strict=True))


def kept(spark, rows):
    return {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame([(i, t, lang, src, len(t)) for i, (t, lang, src) in enumerate(rows)], DOCS)).collect()}


def prose(k, n, symbol=0):
    """n words, ``symbol`` of them followed by a symbol."""
    return " ".join(f"w{(k * 7919 + i * 31) % 9973}{'#' * (i < symbol)}" for i in range(n))


def test_fences_follow_each_group(spark):
    """The same text is an outlier in a source without symbols and none in one that is full of them; more spread widens the fences."""
    probe = prose(5000, 100, 40)
    quiet = [(prose(k, 60 + k % 90), "en", "quiet") for k in range(300)]
    loud = [(prose(k, 60 + k % 90, 5 + k % 40), "en", "loud") for k in range(300, 600)]
    got = kept(spark, [*quiet, *loud, (probe, "en", "quiet"), (probe, "en", "loud")])
    assert not got[600] and got[601]
    assert sum(got[i] for i in range(600)) >= 590


def test_small_groups_borrow_by_weight(spark):
    """A few rows of a new source are judged mostly as their language's."""
    quiet = [(prose(k, 60 + k % 90), "en", "quiet") for k in range(300)]
    got = kept(spark, [*quiet, (prose(900, 100), "en", "new"), (prose(901, 100, 60), "en", "new"), (prose(902, 80), "xx", "other")])
    assert got[300] and not got[301] and got[302]


def test_a_source_of_copies_keeps_the_rest(spark):
    """Where most rows are one text, quartiles coincide; the language's spread still holds."""
    quiet = [(prose(k, 60 + k % 90), "en", "quiet") for k in range(300)]
    copies = [(prose(7, 70), "en", "copies")] * 300
    got = kept(spark, [*quiet, *copies, *((prose(k, 60 + k % 90), "en", "copies") for k in range(50))])
    assert sum(got.values()) >= 640
    assert all(kept(spark, [(prose(7, 70), "en", "s")] * 20).values())


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [*ODD, prose(1, 80)], extra=True)
    names = ["lang_", "metric", "bucket", "rows", "q1", "q3", "spread", "n", "n_lines", *(f"{m}{e}" for m in quality.METRICS for e in ("", "_hi", "_lo"))]
    wide = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    assert quality.keep_good(wide).columns == wide.columns
    assert quality.keep_good(wide).count() == quality.keep_good(df).count() > 0
    assert sorted(quality.quality_rules(wide).collect(), key=str) == sorted(quality.quality_rules(df).collect(), key=str)
