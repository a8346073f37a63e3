"""Quality rules with thresholds that follow the data.

Every text gets four integer metrics. Per (language, source) and metric a mergeable
quantile sketch is kept: counts by log-linear bucket (bucket width at most 1/128 of the
value), so that sketches of partitions, sources or languages merge by adding counts,
in any order, with the same result. Tukey fences read off the sketches replace fixed
cutoffs; a joined filter applies them.

Rates of rare things are smoothed by a few pseudo-counts. So they differ from text to text even where
nearly all texts have none, and quartiles have a spread: that of the resolution at which texts of the
group's lengths can show a rate. Fences lie in the buckets' own, logarithmic scale, FENCE times the spread
outside the quartiles. Quartiles of a group are means, weighted by rows, of its own and of PRIOR rows of
its language, whose are likewise of its own and of the whole table. Where a group's own quartiles coincide,
as it is mostly copies of one text, the spread is that of the level above; a metric whose quartiles
coincide at all levels judges nobody.

Defined results for odd input: a null text has no words; a null language or source is
the empty string. Repeated rows count as often as they occur. Other columns of the input are
ignored or passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import spilled, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows of the level above that count towards a group's quartiles.
PRIOR = 20
#: Fences lie FENCE times the interquartile range outside the quartiles.
FENCE = 3
#: Digits of a bucket.
DIGITS = 8
#: Quartiles and fences are kept in thousandths of a bucket.
MILLI = 1000
#: metric -> whether low values are outliers too
METRICS = {"symbol_ppm": False, "dup_line_ppm": False, "repeat_ppm": False, "word_milli": True}
#: metric -> pseudo-counts: of the thing, and of what may be one
SMOOTH = {"symbol_ppm": (1, 1000), "dup_line_ppm": (1, 10), "repeat_ppm": (8, 80)}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *METRICS)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of 8 words that occur twice or more, exactly.

    Ranks of runs of 1, 2, 4 and 8 words are built by doubling, so equal ranks mean
    equal runs and nothing depends on hashes.
    """
    n = len(words)
    if n <= window:
        return 0
    first: dict[str, int] = {}
    rank = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    if len(first) == n:
        return 0
    width, last = 1, None
    while width < window:
        pairs = rank[:-width] * np.int64(n + 1) + rank[width:]
        distinct, rank, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        width, last = 2 * width, times
    twice = last[rank] >= 2
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def features(text: str) -> tuple[int, ...]:
    """The values of FEATURES for one text."""
    words = WORD.findall(text)
    n = len(words)
    chars = len("".join(words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    rate = lambda m, k, of: (k + SMOOTH[m][0]) * 1_000_000 // (of + SMOOTH[m][1])
    return (
        n, chars, symbols, dup, repeat, len(lines),
        rate("symbol_ppm", symbols, chars), rate("dup_line_ppm", dup, len(lines)), rate("repeat_ppm", repeat, n), chars * 1000 // max(n, 1),
    )


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs``, and the features of ``text`` as _q_<name>."""
    kept = [F.col(f"`{c}`") for c in keep]
    names = [f"_q_{x}" for x in FEATURES]
    source = docs.select(*kept, text_of().alias("_q_text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(x, T.LongType()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            rows = [features(x) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """The number of the value's bucket, which follows from its top DIGITS binary digits: linear below 2 ** DIGITS, then as many buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return shift.cast("bigint") * (1 << DIGITS - 1) + F.call_function("shiftright", value, shift)


def sketch(feats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one quantile sketch for each group and metric."""
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(f"_q_{m}")).alias("bucket")) for m in METRICS)))
    return feats.select("_q_lang", "_q_source", metric.alias("m")).groupBy("_q_lang", "_q_source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to ``keys``: rows and the quartiles' buckets (in thousandths) of each metric."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bucket"))) * MILLI
    return run.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))


def shrunk(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles drawn towards those of the level above as if it had PRIOR rows, and the spread that counts."""
    both = own.join(above.select(*keys, "metric", *(F.col(c).alias(f"above_{c}") for c in ("q1", "q3", "spread"))), [*keys, "metric"])
    mean = lambda c: F.expr(f"({c} * rows + above_{c} * {PRIOR}) div (rows + {PRIOR})").alias(c)
    drawn = both.select(*(c for c in own.columns if c not in ("q1", "q3")), mean("q1"), mean("q3"), F.when(F.col("q1") == F.col("q3"), F.col("above_spread")).alias("_spread"))
    return drawn.withColumn("spread", F.coalesce("_spread", F.col("q3") - F.col("q1"))).drop("_spread")


def thresholds(sketches: DataFrame) -> DataFrame:
    """The fences that hold for each (lang, source): _q_<metric>_lo and _hi."""
    every = quartiles(sketches, []).withColumn("spread", F.col("q3") - F.col("q1"))
    lang = shrunk(quartiles(sketches, ["_q_lang"]), F.broadcast(every), [])  # a row for each metric
    own = shrunk(quartiles(sketches, ["_q_lang", "_q_source"]), lang, ["_q_lang"])
    judging = F.col("spread") > 0
    out = []
    for m, low in METRICS.items():
        of = lambda c, m=m: F.max(F.when((F.col("metric") == m) & judging, c))
        out += [of(F.col("q3") + FENCE * F.col("spread")).alias(f"_q_{m}_hi"), (of(F.col("q1") - FENCE * F.col("spread")) if low else F.lit(None).cast("bigint")).alias(f"_q_{m}_lo")]
    return own.groupBy("_q_lang", "_q_source").agg(*out)


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (null languages and sources as they are), the features as _q_<name>, base_failed and kept.

    Features are written, texts are not: where texts are kept, their features are computed a second time,
    which costs less than a copy of all texts on disk.
    """
    keep = docs.columns if keep is None else keep
    grouped = docs.withColumns({"_q_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_q_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    if "text" in keep:
        limits = spilled(thresholds(spilled(sketch(with_features(grouped, ["_q_lang", "_q_source"])), "quality-sketches")), "quality-fences")
        feats = with_features(grouped, [*keep, "_q_lang", "_q_source"])
    else:
        feats = spilled(with_features(grouped, [*keep, "_q_lang", "_q_source"]), "quality")
        limits = spilled(thresholds(sketch(feats)), "quality-fences")
    base = (F.col("_q_n_words") < MIN_WORDS) | (F.col("_q_n_repeat_words") * 100 > F.col("_q_n_words") * MAX_REPEAT_PERCENT)
    inside = F.lit(True)
    for m in METRICS:
        place = bucket(F.col(f"_q_{m}")) * MILLI
        inside = inside & F.coalesce(place <= F.col(f"_q_{m}_hi"), F.lit(True)) & F.coalesce(place >= F.col(f"_q_{m}_lo"), F.lit(True))
    rows = feats.join(limits, ["_q_lang", "_q_source"], "left").withColumns({"_q_failed": base, "_q_kept": ~base & inside})
    return rows.select(*(F.col(f"`{c}`") for c in keep), *(f"_q_{x}" for x in FEATURES), F.col("_q_failed"), F.col("_q_kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept, the number of lines and the metrics."""
    counts, more = FEATURES[:5], FEATURES[5:]
    named = lambda names: [F.col(f"_q_{x}").alias(x) for x in names]
    return judged(docs, ["doc_id"]).select("doc_id", *named(counts), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), *named(more))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    return judged(docs).where("_q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
