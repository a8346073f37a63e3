"""All pairs of bags over few fingerprints, block by block: any two share some, so a join on keys would meet every pair several times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct fingerprints up to which bags are compared as vectors of counts.
FEW = 64
#: Forms of a block.
BLOCK = 8192
_EDGES = "left_id bigint, left_size bigint, right_id bigint, right_size bigint, score double"
#: Pairs that are passed on together.
TOGETHER = 200_000
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def few_fingerprints(bag: DataFrame) -> bool:
    return bag.select("fp").distinct().limit(FEW + 1).count() <= FEW


def _scores(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(row of a, first and last row of b, exclusive, sums of minima, scores) between two blocks, sorted by (kind, size, id) each; all pairs whose sizes allow it once."""
    ids, kinds, sizes, counts = b
    small = max((int(x[2].max()) for x in (a, b) if len(x[2])), default=0) < 1 << 15
    cols = [np.ascontiguousarray(c, np.int16 if small else np.int64) for c in counts.T]
    for k in range(len(a[0])):
        kind, size = int(a[1][k]), int(a[2][k])
        lo, hi = np.searchsorted(kinds, [kind, kind + 1])
        if threshold > 0:
            lo, hi = lo + np.searchsorted(sizes[lo:hi], [np.floor(size * threshold - 1e-6), np.ceil(size / threshold + 1e-6) + 1])
        if same:
            lo = max(lo, k + 1)
        if lo >= hi:
            continue
        common = np.zeros(hi - lo, cols[0].dtype)
        for c, col in zip(a[3][k].tolist(), cols, strict=True):
            if c:
                common += np.minimum(col[lo:hi], col.dtype.type(c))
        yield k, int(lo), int(hi), common, common / (size + sizes[lo:hi] - common)


def _edges(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Edges between two blocks."""
    ids, _, sizes, _ = b
    for k, lo, hi, common, score in _scores(a, b, same, threshold):
        size = int(a[2][k])
        ok = np.flatnonzero((score >= threshold) & (common > 0))
        if len(ok):
            other, far, own = ids[lo:hi][ok], sizes[lo:hi][ok], int(a[0][k])
            first = (size < far) | ((size == far) & (own < other))
            yield np.where(first, own, other), np.where(first, size, far), np.where(first, other, own), np.where(first, far, size), score[ok]


def dense_scores(bag: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """(left_id, left_size, right_id, right_size, score) of pairs of one kind that share a fingerprint and reach the threshold; left is the smaller by (size, id).

    ``forms`` has form_id, kind and bag_size. A block is a row of counts, sent once for each pair of blocks it is in; pairs aren't shuffled.
    """
    met, n_blocks, width = _met(bag, forms)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in _EDGES.split(", ")])

        for a, b, alone in _block_pairs(batches, n_blocks, width):
            for cols in _edges(a, b, alone, threshold):
                held.append(cols)
                n += len(cols[0])
                if n >= TOGETHER:
                    yield out()
                    n = 0
        if held:
            yield out()

    return met.mapInArrow(meet, _EDGES)


def dense_counts(bag: DataFrame, forms: DataFrame, threshold: float, floors: list[float]) -> DataFrame:
    """(score, pairs): how many of ``dense_scores``' pairs have a score below 1 that lies between a floor (from ``threshold`` on, ascending) and the next; score is that floor.

    Pairs are counted where their blocks meet: a task passes on a row for each floor.
    """
    met, n_blocks, width = _met(bag, forms)
    least = [threshold, *(x for x in floors if x > threshold)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * (len(least) + 1)
        for a, b, alone in _block_pairs(batches, n_blocks, width):
            for _, _, _, common, score in _scores(a, b, alone, threshold):
                if threshold <= 0:
                    score = score[common > 0]
                for k, x in enumerate((*least, 1.0)):
                    n[k] += int(np.count_nonzero(score >= x))
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.float64()), pa.array([x - y for x, y in zip(n, n[1:], strict=False)], pa.int64())], names=["score", "pairs"])

    return met.mapInArrow(meet, "score double, pairs bigint").groupBy("score").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def _block_pairs(batches: Iterator[pa.RecordBatch], n_blocks: int, width: int) -> Iterator[tuple[Block, Block, bool]]:
    one: tuple[int, Block] | None = None
    for b in batches:
        for pair, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            block = (*(np.frombuffer(x, np.int64) for x in data[:3]), np.frombuffer(data[3], np.int32).reshape(-1, width))
            alone = pair // n_blocks == pair % n_blocks
            if not alone and (one is None or one[0] != pair):
                one = (pair, block)
                continue
            yield block if alone else one[1], block, alone


def _met(bag: DataFrame, forms: DataFrame) -> tuple[DataFrame, int, int]:
    """(the two blocks of each pair, or its one, side by side; the number of blocks; that of fingerprints)."""
    names = sorted(r["fp"] for r in bag.select("fp").distinct().collect())  # at most FEW
    place = F.create_map(*(F.lit(x) for k, fp in enumerate(names) for x in (fp, k))) if names else F.lit(None)
    width = max(len(names), 1)
    known = forms.where("kind is not null")
    kinds = {r["kind"]: k for k, r in enumerate(known.select("kind").distinct().collect())}
    n_blocks = max(1, -(-known.count() // BLOCK))
    items = bag.groupBy("form_id").agg(F.collect_list(F.struct(place[F.col("fp")].alias("at"), F.col("cnt").cast("int").alias("cnt"))).alias("items")) if names else bag.selectExpr("form_id", "array(struct(0 as at, 0 as cnt)) as items").limit(0)
    rows = items.join(known.select("form_id", "kind", "bag_size"), "form_id").withColumn("block", F.pmod(F.xxhash64("form_id"), F.lit(n_blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            held.sort()
            counts = np.zeros((len(held), width), np.int32)
            for k, (_, _, _, item) in enumerate(held):
                for x in item:
                    counts[k, x["at"]] = x["cnt"]
            kind, size, ids = (np.array([x[c] for x in held], np.int64) for c in range(3))
            data = [x.tobytes() for x in (ids, kind, size, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["block", "ids", "kinds", "sizes", "counts"])
            held.clear()

        for b in batches:
            for block, kind, size, form, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now and held:
                    yield from done()
                now = block
                held.append((kinds[kind], size, form, item))
        if held:
            yield from done()

    blocks = rows.select("block", "kind", "bag_size", "form_id", "items").repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(pack, "block int, ids binary, kinds binary, sizes binary, counts binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    met = blocks.withColumn("other", other).withColumn("pair", F.least("block", "other") * n_blocks + F.greatest("block", "other"))

    n_pairs = n_blocks * (n_blocks + 1) // 2
    return met.select("pair", "ids", "kinds", "sizes", "counts").repartition(n_pairs, "pair").sortWithinPartitions("pair"), n_blocks, width
