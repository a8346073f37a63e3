"""Packing token sequences by non-negative least squares.

A document's ids, with id 0 behind, are cut into pieces that fill a window and one rest. Only the
histogram of the rests' lengths (at most window - 1 numbers) reaches the driver. There,
shallow combinations of lengths that fill the window exactly are enumerated; non-negative
least squares solves how often to repeat each so that the histogram is used up; the
counts are rounded down, and what they leave is packed greedily, again by combinations with
repeats. Each combination owns a range of ranks of each of its lengths. Executors number the
rests of a length (by partition, with offsets) and look up sequence and offset by rank, so
no task ever gathers all pieces of a length.

Defined results for odd input: a null text is the empty one (its piece is the single id 0);
rows are packed one by one, also if their doc_id is null or repeated; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import spilled, text_of
from .bpe import byte_letters

WINDOW = 1024
#: Combinations of three lengths that are tried, the most plentiful first.
TRIPLES = 4000
SWEEPS = 60
#: Ids of full pieces' sequences start here; those of combinations start at 0.
FULL_BASE = 1 << 61


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_encoding(path: str):
    """The tokenizer at ``path`` for the faster rank library, if it is plain byte-level BPE whose merges are in the order of their ids; else None. Both give the same ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix", "continuing_subword_prefix", "fuse_unk")):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Texts to little-endian 32-bit ids, as the tokenizers library has them."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = rank_encoding(path)
        self._library = None

    @property
    def library(self):
        """Loaded where it is needed only: it is large."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.fast is None or any(s in text for s in self.special):  # strings of special tokens are the library's business
                ids = self.library.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(np.array(ids, "<u4").tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece; full ones have their sequence, rests their rank among those of the same length in this partition."""
    vocabulary = vocabulary or default_vocabulary()
    long = lambda x: T.StructField(x, T.LongType())
    schema = T.StructType([docs.select("doc_id").schema[0], *map(long, ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "part", "rank"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        full, seen = 0, [0] * window
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            doc, rows = [], []
            for k, ids in enumerate(encode(b.column(1).to_pylist())):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    doc.append(k)
                    if length == window:
                        rows.append((start, length, crc, n, FULL_BASE + (part << 32) + full, part, None))
                        full += 1
                    else:
                        rows.append((start, length, crc, n, None, part, seen[length]))
                        seen[length] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def combinations(hist: np.ndarray, window: int, triples: int = TRIPLES) -> list[dict[int, int]]:
    """length -> times, for one, two or three pieces that fill the window exactly."""
    have = np.flatnonzero(hist)
    found = [{int(a): 1, window - int(a): 1} if 2 * a != window else {int(a): 2} for a in have if 2 * a <= window and hist[window - a]]
    # three: the lengths with most pieces as the first two, any that fits as the third
    top = have[np.argsort(-hist[have], kind="stable")][:256]
    rows = []
    for i, a in enumerate(top.tolist()):
        b = top[i:]
        c = window - a - b
        ok = (c > 0) & (c < window)
        ok[ok] = hist[c[ok]] > 0
        rows += [(int(min(hist[a], hist[x], hist[y])), *sorted((a, int(x), int(y)))) for x, y in zip(b[ok], c[ok], strict=True)]
    for _, *lengths in sorted(set(rows), key=lambda r: (-r[0], r[1:]))[:triples]:
        found.append({x: lengths.count(x) for x in lengths})
    return found


def solve(columns: list[dict[int, int]], hist: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that makes the sum of x times the columns closest to the histogram: coordinate descent, each step exact."""
    x = np.zeros(len(columns))
    rest = hist.astype(np.float64).tolist()
    work = [(list(c.items()), sum(v * v for v in c.values())) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (items, norm) in enumerate(work):
            step = sum(v * rest[k] for k, v in items) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, v in items:
                    rest[k] -= v * step
        if moved < 0.05:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times)]) of combinations that use each rest exactly once."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(combo: dict[int, int], most: int) -> None:
        times = min(most, *(int(left[k]) // v for k, v in combo.items()))
        if times > 0:
            for k, v in combo.items():
                left[k] -= times * v
            out.append((times, sorted(combo.items(), reverse=True)))

    columns = combinations(hist, window)
    for combo, x in sorted(zip(columns, solve(columns, hist), strict=True), key=lambda c: -c[1]):
        take(combo, int(x + 1e-9))
    while left.any():  # the rest: the largest that fits, again and again; each round uses up a length at least
        combo, room = {}, window
        for k in np.flatnonzero(left)[::-1].tolist():
            if k <= room and (v := min(int(left[k]), room // k)):
                combo[k] = v
                room -= v * k
        take(combo, 1 << 62)
    return out


class Places:
    """Sequence and offset of the r-th rest of a length."""

    def __init__(self, plans: list[tuple[int, list[tuple[int, int]]]], window: int = WINDOW):
        table: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]
        upto, base = [0] * window, 0
        for repeats, combo in plans:
            offset = 0
            for length, times in combo:
                table[length].append((upto[length], base, offset, times))
                upto[length] += repeats * times
                offset += times * length
            base += repeats
        self.table = [np.array(t, np.int64).reshape(-1, 4) for t in table]

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k in np.unique(lengths):
            at = np.flatnonzero(lengths == k)
            t = self.table[k]
            row = t[np.searchsorted(t[:, 0], ranks[at], side="right") - 1]
            nth = ranks[at] - row[:, 0]
            seq[at] = row[:, 1] + nth // row[:, 3]
            off[at] = row[:, 2] + nth % row[:, 3] * k
        return seq, off


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = spilled(cut_pieces(docs, window, vocabulary), "pieces")
    rests = pieces.where("rank is not null")
    by_part = spilled(rests.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(window, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # window - 1 rows at most
        hist[r["length"]] = r["n"]
    places = Places(plan(hist, window), window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a merged join on purpose: there are offsets for each partition, so they grow with the data
    ranked = rests.join(offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    schema = T.StructType([*(pieces.schema[c] for c in cols), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places(b.column(2).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=schema.names)

    placed = ranked.select(*cols[:5], "rank").mapInArrow(run, schema)
    return pieces.where("rank is null").select(*cols, F.lit(0).cast("bigint").alias("offset")).unionByName(placed)
