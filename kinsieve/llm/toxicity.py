"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled rows (MAX_TRAIN, those with the smallest hash of their id) is
   split: every third row of each kind is for calibration, the others are for fitting.
2. Words, and beginnings of words, that toxic texts of the fitting part hold far more often
   than others become the lexicon (at most MAX_TERMS), beside a short fixed one.
3. One pass over all texts makes the features: lexicon densities, second-person proximity,
   capitals, punctuation and obfuscation rates.
4. Trees are fitted on the sample's features; an isotonic curve maps their sum to a
   probability; a pass over the features scores every row.

Labels come only from rows that are not held out; labels, lang, source and ids are no inputs.

Defined results for odd input: a null text is the empty one and gets a score as any other;
rows with a null doc_id are scored and count as not held out; where all labels are of one kind every
score is that label (0 without any labels); with fewer than three rows of a kind, all serve to fit and to
calibrate; repeated label rows count as one, toxic if any of them is; of labelled rows that repeat a doc_id,
the one with the least features is fitted on; null labels are none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import spilled, text_of

#: The most labelled rows that are fitted on.
MAX_TRAIN = 20_000
MAX_TERMS = 4_000
PREFIXES = (4, 5, 6, 7)
LEAST_ODDS = 2.0
CUT = 0.3
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
MASKED = re.compile(r"[^\W\d_][0-9@$*!#]+[^\W\d_]")
NEAR = 5
#: Fixed list.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb jerk fool hate kill ugly shut garbage vermin idiotas estúpido tonto basura asco connard imbécile crétin ordure débile dumm idiotisch abschaum dreck trottel".split())
#: Fixed list.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted ustedes vosotros".split())
NAMES = (
    "words", "hits", "hit_rate", "odds", "odds_rate", "strongest", "kinds", "begins", "begin_rate", "begin_strongest", "begin_kinds", "seed_rate",
    "near_second", "second_rate", "caps", "caps_words", "exclaim", "question", "punct", "runs", "masked", "masked_hits",
)
LEET = str.maketrans("013457@$!", "oieastasi")


def terms(text: str) -> set[str]:
    """The distinct words of a text, and beginnings of words with a star behind."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


class Features:
    """Dense features of a text, given a lexicon term -> log odds."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.kept: dict[str, tuple[float, float]] = {}

    def of_word(self, w: str) -> tuple[float, float]:
        """(log odds of the word, largest log odds of its beginnings)"""
        if (got := self.kept.get(w)) is None:
            lex = self.lexicon
            got = (lex.get(w, 0.0), max([lex.get(w[:k] + "*", 0.0) for k in PREFIXES if len(w) > k], default=0.0))
            if len(self.kept) >= 100_000:
                self.kept.clear()
            self.kept[w] = got
        return got

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        n = max(len(words), 1)
        pairs = list(map(self.of_word, words))
        own = [(i, a) for i, (a, _) in enumerate(pairs) if a]
        begun = [(i, b) for i, (_, b) in enumerate(pairs) if b]
        seed = [i for i, w in enumerate(words) if w in INSULTS]
        second = [i for i, w in enumerate(words) if w in SECOND]
        hot = sorted({i for i, _ in own} | set(seed))
        near = 0
        if hot and second:
            at = np.searchsorted(second, hot)
            s = np.array([-(10**9), *second, 10**9])
            near = int((np.minimum(np.abs(s[at] - hot), np.abs(s[at + 1] - hot)) <= NEAR).sum())
        chars = max(len(text), 1)
        letters = max(sum(map(len, words)), 1)
        caps = sum(1 for c in text if c.isupper()) if not text.islower() else 0
        masked = MASKED.findall(text)
        unmasked = 0
        if masked:
            unmasked = sum(1 for t in TOKEN.findall(low) if MASKED.search(t) and (w := t.translate(LEET).strip(".,!?;:")) and (w in INSULTS or self.lexicon.get(w)))
        return [
            math.log1p(len(words)), len(own), len(own) / n, sum(a for _, a in own), sum(a for _, a in own) / n, max([a for _, a in own], default=0.0), len({words[i] for i, _ in own}),
            sum(b for _, b in begun), sum(b for _, b in begun) / n, max([b for _, b in begun], default=0.0), len({words[i] for i, _ in begun}), len(seed) / n,
            near, len(second) / n, caps / letters, sum(1 for w in WORD.findall(text) if len(w) > 1 and w.isupper()) / n, text.count("!") / n, text.count("?") / n,
            sum(map(text.count, ".,;:!?")) / chars, sum(map(text.count, ("!!", "??", "!?", "..."))) / n, len(masked) / n, unmasked,
        ]


class Trees:
    """Boosted trees for the logistic loss, on binned features, with depth-wise growth."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # a value that nearly all rows share still leaves room for the others
        self.edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 17)[:-1])])) if len(v := x[:, j][x[:, j] > (e[-1] if len(e) else -np.inf)]) else e for j, e in enumerate(self.edges)]
        b = self._binned(x)
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(p / (1 - p))
        score = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = max(map(len, self.edges)) + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feat, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                base, nodes = 2**level - 1, 2**level
                best = np.zeros(nodes)
                for j in range(b.shape[1]):
                    key = (node - base) * width + b[:, j]
                    gs = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
                    hs = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(nodes), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feat[base : base + nodes][better] = j
                    cut[base : base + nodes][better] = at[better]
                f, c = feat[node], cut[node]
                right = (f >= 0) & (b[np.arange(len(y)), np.maximum(f, 0)] > c)
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            n = 2**self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
            score += value[leaf]
            self.trees.append((feat, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        r = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feat[node]
                node = 2 * node + 1 + ((f >= 0) & (b[r, np.maximum(f, 0)] > cut[node]))
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing fit (pool adjacent violators): mean scores and values of its blocks, to interpolate between."""
    level, at = np.unique(score, return_inverse=True)  # equal scores are one
    times = np.bincount(at).astype(float)
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v, n in zip(level.tolist(), np.bincount(at, y).tolist(), times.tolist(), strict=True):
        blocks.append([v, n, s * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Calibrated:
    """Trees with an isotonic curve; a trace of the raw score keeps equal plateaus in order."""

    def __init__(self, trees: Trees, x: np.ndarray, y: np.ndarray):
        self.trees = trees
        self.at, self.value = isotonic(trees.predict(x), y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.predict(x)
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def training_rows(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y, part) of at most ``most`` labelled rows that are not held out: part 1, every third of each kind, to calibrate, part 0 to fit."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = rows.where(fold(F.col("doc_id")) != 2).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    some = rows.orderBy("h", "doc_id").limit(most)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).select("doc_id", "y", (F.col("n") % 3 == 0).cast("int").alias("part"))


def learn_lexicon(texts: DataFrame, most: int = MAX_TERMS) -> dict[str, float]:
    """Terms of toxic texts with their log odds, from rows (text, y). Each partition sends its counts, not its texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0, 0]
        seen = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y] += 1
                seen[y].update(terms(text))
        names = ["", *seen[1]]  # only terms that some toxic text holds matter, and the count of rows
        neg = [n[0], *(seen[0].get(t, 0) for t in seen[1])]
        others = [t for t in seen[0] if t not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(names + others, pa.string()), pa.array([n[1], *seen[1].values(), *[0] * len(others)], pa.int64()), pa.array(neg + [seen[0][t] for t in others], pa.int64())], names=["term", "p", "n"])

    counts = texts.select("text", "y").mapInArrow(count, "term string, p bigint, n bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counts = spilled(counts.where("term = '' or p >= 3"), "lexicon")
    total = counts.where("term = ''").first()
    if total is None or not total["p"] or not total["n"]:
        return {}
    p, n = total["p"], total["n"]
    odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    best = counts.where("term <> ''").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy((F.col("p") * F.col("odds")).desc(), "term").limit(most).select("term", "odds")
    return {r["term"]: round(r["odds"], 3) for r in best.collect()}


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and f, the list of NAMES."""
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("f", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(lexicon)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(x) for x in b.column(1).to_pylist()], pa.list_(pa.float32()))], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def fit(rows: list) -> Calibrated | float:
    """A model from the sample's rows (f, y, part). If a part lacks one kind, all rows serve to fit and to calibrate; if all are of one kind, the score is their label."""
    if not rows:
        return 0.0
    x, y, part = np.array([r["f"] for r in rows], np.float64), np.array([r["y"] for r in rows], np.float64), np.array([r["part"] for r in rows])
    if len(np.unique(y)) < 2:
        return float(y[0])
    if any(len(np.unique(y[part == k])) < 2 for k in (0, 1)):
        return Calibrated(Trees().fit(x, y), x, y)
    return Calibrated(Trees().fit(x[part == 0], y[part == 0]), x[part == 1], y[part == 1])


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, cut: float = CUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    sample = spilled(training_rows(labels, max_train), "toxic-sample")
    one = docs.select("doc_id", text_of().alias("text"))
    small = F.broadcast(sample)  # max_train rows of 16 bytes at most
    lexicon = learn_lexicon(one.join(small.where("part = 0"), "doc_id"))
    feats = spilled(with_features(docs, lexicon), "toxic-features")
    known = feats.join(small, "doc_id").groupBy("doc_id").agg(F.min(F.struct("f", "y", "part")).alias("r")).select("doc_id", "r.*")
    model = fit(known.orderBy("doc_id").collect())  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float):
                s = np.full(b.num_rows, model)
            else:
                s = model(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = feats.mapInArrow(run, T.StructType([feats.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
