"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed five-word runs; two are linked if their Jaccard similarity is at least
0.8. Texts with equal sets are one class, met once.

1. MinHash values, cut into BANDS of ROWS, propose candidates: a linked pair shares no
   band with a probability below 3e-6. Only the least class of each bucket is linked to
   the others, so a bucket of any size costs one row for each member.
2. Connected components of those links are the candidate groups, the families. Large ones are dealt into
   blocks by hash, of about BLOCK_BYTES; each pair of blocks is a group of bounded size.
3. Within a block the values are compared step by step. A pair is dropped as soon as
   the posterior probability (uniform prior) that its similarity reaches the threshold falls
   below TOLERANCE; all others are verified exactly on the whole sets.
4. A block returns, for each class, how many rows it is linked to and the least class
   of its component, never the pairs. Counts are added up; components are joined.

Comparing the members of one family with each other takes time in the square of its size, as each may
or may not be linked with each. Tasks are bounded and no pairs are made rows of; but each block meets
each other one of its family, so a class of a family of B blocks is sent B times.

Defined results for odd input: a text without words (null, empty) is linked to nothing; one
to four words are one run; rows with a null doc_id are linked to nothing and keep a null class;
rows that share a doc_id are one document, with the text of the least set hash; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import shingles
from ._common import spilled, text_of

THRESHOLD = 0.8
BANDS, ROWS = 42, 6
STEP = 36
TOLERANCE = 1e-7
#: Bytes of sets and MinHash values in a block; a task holds two blocks.
BLOCK_BYTES = 12_000_000
#: Classes in a block: as many as a shuffle's partition has, between these.
BLOCK, BLOCK_MOST = 512, 2048
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minhash(values: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set, in bounded memory whatever its size."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 4096):
        part = values[i : i + 4096]
        for k in range(0, len(_A), 36):
            out[k : k + 36] = np.minimum(out[k : k + 36], (part[None, :] * _A[k : k + 36, None] + _B[k : k + 36, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    s = signature.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = shingles.mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return h


@cache
def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``compared`` with which a pair stays: P(similarity >= threshold | matches) >= tolerance."""
    n, below = compared + 1, 0.0
    for m in range(compared + 1):
        below += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below >= tolerance:
            return m
    return compared


def surviving(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that Bayesian pruning leaves; for one block with itself those with i < j."""
    i_all, j_all = [], []
    for i in range(0, len(left), 64):
        part = left[i : i + 64]
        matches = (part[:, None, :STEP] == right[None, :, :STEP]).sum(2)
        a, b = np.nonzero(matches >= least_matches(STEP))
        m = matches[a, b]
        a = a + i
        if same:
            keep = a < b
            a, b, m = a[keep], b[keep], m[keep]
        for at in range(STEP, left.shape[1], STEP):
            if not len(a):
                break
            m = m + (left[a, at : at + STEP] == right[b, at : at + STEP]).sum(1)
            keep = m >= least_matches(min(at + STEP, left.shape[1]))
            a, b, m = a[keep], b[keep], m[keep]
        i_all.append(a)
        j_all.append(b)
    return np.concatenate(i_all) if i_all else np.zeros(0, int), np.concatenate(j_all) if j_all else np.zeros(0, int)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs reach the threshold, exactly."""
    if not len(i):
        return np.zeros(0, bool)
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.array([len(s) for s in sets])
    columns, col = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    if len(used) ** 2 * len(columns) < len(i) * 400_000:  # a family: intersections as a matrix product, some columns at a time
        row = np.repeat(np.arange(len(used)), size[used])
        common = np.zeros((len(used), len(used)), np.float32)
        width = max(256, 8_000_000 // len(used))
        for c in range(0, len(columns), width):
            of = (col >= c) & (col < c + width)
            part = np.zeros((len(used), min(width, len(columns) - c)), np.float32)
            part[row[of], col[of] - c] = 1
            common += part @ part.T
        both = common[at[: len(i)], at[len(i) :]].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def class_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sets(docs: DataFrame, full: bool) -> DataFrame:
    """(doc_id, key, n, and keys of the bands or, if full, the set and its MinHash values); a text without words has a null key."""
    schema = "doc_id bigint, key binary, n int, " + ("members binary, signature binary" if full else "bands array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                key, n, x, y = [], [], [], []
                for s in map(np.unique, shingles.sequences(part.column(1).to_pylist())):
                    key.append(class_key(s) if len(s) else None)
                    n.append(len(s))
                    sig = minhash(s) if len(s) else None
                    if full:
                        x.append(s.tobytes())
                        y.append(None if sig is None else sig.tobytes())
                    else:
                        x.append([] if sig is None else bands(sig).view(np.int64))
                more = [pa.array(x, pa.binary()), pa.array(y, pa.binary())] if full else [pa.array(x, pa.list_(pa.int64()))]
                names = ["doc_id", "key", "n", *(["members", "signature"] if full else ["bands"])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int32()), *more], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks: for each node its links here and the least node of its component here."""
    pdf = pdf.drop_duplicates("node").sort_values("node", kind="stable").reset_index(drop=True)
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["signature"]])
    sets = [np.frombuffer(s, np.uint64) for s in pdf["members"]]
    block, copies = pdf["block"].to_numpy(), pdf["copies"].to_numpy()
    if lo == hi:
        i, j = surviving(sig, sig, True)
    else:
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        i, j = surviving(sig[left], sig[right], False)
        i, j = left[i], right[j]
    ok = verified(sets, i, j)
    i, j = i[ok], j[ok]
    links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
    root = np.arange(len(pdf))  # nodes are in order, so the least index is the least node
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    node = pdf["node"].to_numpy()
    out = pd.DataFrame({"node": node, "links": links.astype("int64"), "root": node[root]})
    return out[out["links"] > 0]


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes): doc_id, key, node; and for each node (its least doc_id) copies, links and class."""
    keep = lambda df: spilled(df, "jaccard")
    every = keep(_sets(docs, False))
    one = F.min(F.struct("key", "n", "bands")).alias("s")
    rows = every.where("doc_id is not null and key is not null").groupBy("doc_id").agg(one).select("doc_id", "s.key", "s.n", "s.bands")
    nodes = keep(rows.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("bucket", "least")
    # a merged join on purpose: both sides grow with the data, so the plan is the same at every size
    stars = entries.join(buckets.hint("merge"), "bucket").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = keep(connected_components(stars, keep))
    members = groups.join(nodes.select("node", "key", "copies", "n"), "node")
    spark = docs.sparkSession
    each = min(max(BLOCK, BLOCK_MOST), max(BLOCK, groups.count() // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sizes = keep(members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / each, F.sum(F.col("n") * 8 + BANDS * ROWS * 4) / BLOCK_BYTES)).cast("int").alias("blocks")))
    wanted = keep(members.drop("n").join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # the sets of those classes' least documents, once
    members = _sets(docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), True)
    full = wanted.join(members.withColumnRenamed("doc_id", "node"), ["node", "key"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = full.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    parts = keep(dealt.select("root", "lo", "hi", "node", "block", "copies", "signature", "members").groupBy("root", "lo", "hi").applyInPandas(_compare, "node bigint, links bigint, root bigint"))
    classes = connected_components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")), keep)
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "key", "copies").join(links, "node", "left").join(classes, "node", "left")
    known = known.select("node", "key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("class_id"))
    return every.select("doc_id", "key"), known


def similarity_join(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id (least doc_id linked directly or through others), copy_id (least doc_id with the same set), n_links (other documents at 0.8 or more)."""
    every, known = linked_classes(docs)
    rows = every.groupBy("doc_id").agg(F.min("key").alias("key"))
    out = rows.join(known, "key", "left")
    return out.select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("copy_id"),
        F.when(F.col("doc_id").isNotNull() & F.col("node").isNotNull(), F.col("links") + F.col("copies") - 1).otherwise(0).alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose class has a smaller doc_id; rows with a null doc_id stay."""
    drop = spilled(similarity_join(docs).where("class_id < doc_id").select("doc_id"), "jaccard-drop")  # its size is known then
    return docs.join(drop, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
