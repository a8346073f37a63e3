"""Pairs of packed bags at low thresholds, block by block: sketches tell which may reach the threshold, and these are scored where they meet. No pair is shuffled.

A sketch is a bit for each of COLUMNS columns. Occurrences (a fingerprint and which time it is) of the FREQUENT slots that most forms have
stand in columns of their own, others share one by their hash. Two bags have at most as many occurrences in common as they have columns in common,
and the lesser number of those that found their column taken. Pairs whose bound is below what the threshold asks for are dropped; nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import SLOTS, digest, mixed, occurrences, plain, rarity, slots_of, squeezed, unpacked

COLUMNS = 2560
FREQUENT = 1024
#: Forms of a block, or the size of their bags; forms that are met at once.
BLOCK = 8192
ROOM = 4_000_000
TILE = 256
#: Pairs that are passed on together.
TOGETHER = 200_000
_SKETCH = "form_id bigint, kind bigint, size bigint, taken bigint, bits binary, bag binary"
_EDGES = "left_id bigint, left_size bigint, right_id bigint, right_size bigint, score double"
_BLOCK = "block int, ids binary, kinds binary, sizes binary, taken binary, bits binary, entries binary, names binary, places binary, cnts binary"
#: ids, kinds, sizes, taken, bits; entries of each bag; the block's fingerprints; the entries' places among them and counts. Rows are sorted by (kind, size, id).
Block = tuple[np.ndarray, ...]


def columns_of(rare: np.ndarray) -> np.ndarray:
    """For each slot its column, -1 where columns are shared."""
    top = np.argsort(rare, kind="stable")[::-1][:FREQUENT]
    out = np.full(SLOTS, -1, np.int32)
    out[top] = np.arange(len(top))
    return out


def sketch(fp: np.ndarray, cnt: np.ndarray, columns: np.ndarray) -> tuple[int, int, bytes]:
    """(size, occurrences whose column was taken, bits) of a bag."""
    h = occurrences(fp, cnt.astype(np.int64))
    at = columns[slots_of(h)]
    at = np.where(at >= 0, at, FREQUENT + (mixed(h) % np.uint64(COLUMNS - FREQUENT)).astype(np.int32))
    bits = np.zeros(COLUMNS, bool)
    bits[at] = True
    return len(h), len(h) - int(bits.sum()), np.packbits(bits).tobytes()


def _plain(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.reshape(-1, COLUMNS // 8), axis=1).astype(np.float32)


def possible(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of pairs between two blocks that may reach the threshold, sorted by the former."""
    kinds, sizes = b[1:3]
    other = _plain(b[4])
    share = threshold / (1 + threshold) * (1 - 1e-6)
    need, far_need = ((x[2] * share).astype(np.float32) for x in (a, b))
    taken, far_taken = (x[3].astype(np.float32) for x in (a, b))
    cuts = np.flatnonzero(np.append(True, a[1][1:] != a[1][:-1])).tolist()
    for begin, end in zip(cuts, [*cuts[1:], len(a[0])], strict=True):
        first, last = np.searchsorted(kinds, a[1][begin], "left"), np.searchsorted(kinds, a[1][begin], "right")
        for lo in range(begin, end, TILE):
            hi = min(lo + TILE, end)
            near = sizes[first:last]
            x, y = first + np.searchsorted(near, [np.floor(a[2][lo] * threshold - 1e-6), np.ceil(a[2][hi - 1] / threshold + 1e-6) + 1])
            x = max(int(x), lo) if same else int(x)
            if x >= y:
                continue
            bound = _plain(a[4][lo:hi]) @ other[x:y].T
            bound += np.minimum(taken[lo:hi, None], far_taken[None, x:y])
            ok = bound >= need[lo:hi, None] + (far_need[None, x:y] - np.float32(0.01))
            if same:
                ok &= np.arange(x, y)[None, :] > np.arange(lo, hi)[:, None]
            i, j = np.nonzero(ok)
            if len(i):
                yield i + lo, j + x


def edges(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Edges between two blocks: left_id, left_size, right_id, right_size, score; left is the smaller by (size, id)."""
    names, place, cnts = b[6:]
    start = np.cumsum(b[5]) - b[5]
    own_start = np.cumsum(a[5]) - a[5]
    there = np.minimum(np.searchsorted(names, a[6]), len(names) - 1)
    there = np.where(names[there] == a[6], there, -1)  # the places of a's fingerprints in b
    has = np.zeros(len(names), np.uint32)
    for left, right in possible(a, b, same, threshold):
        heads = np.flatnonzero(np.diff(left, prepend=-1)).tolist()
        for lo, hi in zip(heads, [*heads[1:], len(left)], strict=True):
            i, some = int(left[lo]), right[lo:hi]
            span = slice(own_start[i], own_start[i] + a[5][i])
            at = there[a[7][span]]
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            has[at] = a[8][span][hit]
            n = b[5][some]
            cut = np.cumsum(n) - n
            entry = np.repeat(start[some] - cut, n) + np.arange(n.sum())
            common = np.add.reduceat(np.minimum(has[place[entry]], cnts[entry]), cut, dtype=np.int64)
            has[at] = 0
            size, far = int(a[2][i]), b[2][some]
            score = common / (size + far - common)
            ok = np.flatnonzero((score >= threshold) & (common > 0))
            if len(ok):
                own, far, other = int(a[0][i]), far[ok], b[0][some[ok]]
                first = (size < far) | ((size == far) & (own < other))
                yield np.where(first, own, other), np.where(first, size, far), np.where(first, other, own), np.where(first, far, size), score[ok]


def _planes(x: np.ndarray) -> bytes:
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _column(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(plain(data, size * n), np.uint8).reshape(size, n).T).view(kind).ravel()


def _block(rows: list[pa.RecordBatch]) -> list[bytes]:
    t = pa.Table.from_batches(rows)
    ids, kinds, sizes, taken = (t.column(c).to_numpy() for c in ("form_id", "kind", "size", "taken"))
    order = np.lexsort((ids, sizes, kinds))
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
    held = t.column("bag").to_pylist()
    fps, cnts = zip(*(unpacked(held[k]) for k in order.tolist()), strict=True)
    entries = np.array([len(x) for x in fps], np.int64)
    names, places = np.unique(np.concatenate(fps), return_inverse=True)
    steps = np.diff(places.astype(np.int32), prepend=np.int32(0))
    own = [np.ascontiguousarray(x[order]).tobytes() for x in (ids, kinds, sizes, taken)]
    return [*own, squeezed(np.ascontiguousarray(bits[order]).tobytes()), entries.tobytes(), names.tobytes(), _planes(steps), _planes(np.concatenate(cnts))]


def _unblocked(data: list[bytes]) -> Block:
    ids, kinds, sizes, taken, entries = (np.frombuffer(data[k], np.int64) for k in (0, 1, 2, 3, 5))
    n = int(entries.sum())
    bits = np.frombuffer(plain(data[4], len(ids) * COLUMNS // 8), np.uint8).reshape(-1, COLUMNS // 8)
    return ids, kinds, sizes, taken, bits, entries, np.frombuffer(data[6], np.uint64), np.cumsum(_column(data[7], np.int32, n), dtype=np.int32), _column(data[8], np.uint32, n)


def sketch_scores(packed: DataFrame, remaining: DataFrame, threshold: float) -> DataFrame:
    """(left_id, left_size, right_id, right_size, score) of pairs of ``remaining`` forms of one kind that share a fingerprint and reach the threshold, each once; left is the smaller by (size, id).

    A block is a row of sketches and bags, sent once for each other block.
    """
    columns = columns_of(rarity(packed))
    forms, total = remaining.where("kind is not null").agg(F.count("*"), F.coalesce(F.sum("bag_size"), F.lit(0))).first()
    n_blocks = max(1, -(-forms // BLOCK), -(-total // ROOM))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                kind = [int(digest(x.encode())[:15], 16) for x in part.column(1).to_pylist()]
                size, taken, bits = zip(*(sketch(*unpacked(x.as_py()), columns) for x in part.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kind, pa.int64()), pa.array(size, pa.int64()), pa.array(taken, pa.int64()), pa.array(bits, pa.binary()), part.column(2)], names=[x.split(" ")[0] for x in _SKETCH.split(", ")])

    rows = packed.where("kind is not null").join(remaining.select("form_id"), "form_id", "left_semi")
    rows = rows.select("form_id", "kind", "bag").mapInArrow(sketches, _SKETCH).withColumn("block", F.pmod(F.xxhash64("form_id"), F.lit(n_blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.binary()) for x in _block(held))], names=[x.split(" ")[0] for x in _BLOCK.split(", ")])
            held.clear()
            return out

        for b in batches:
            blocks = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist() if len(blocks) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if blocks[lo] != now and held:
                    yield done()
                now = int(blocks[lo])
                held.append(b.slice(lo, hi - lo).drop_columns(["block"]))
        if held:
            yield done()

    blocks = rows.select("block", *(x.split(" ")[0] for x in _SKETCH.split(", "))).repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(pack, _BLOCK)
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("pair", F.least("block", "other") * n_blocks + F.greatest("block", "other"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: tuple[int, Block] | None = None
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in _EDGES.split(", ")])

        for b in batches:
            for k in range(b.num_rows):
                pair, *data = (c[k].as_py() for c in b.columns)
                block = _unblocked(data)
                alone = pair // n_blocks == pair % n_blocks
                if not alone and (one is None or one[0] != pair):
                    one = (pair, block)
                    continue
                for found in edges(block if alone else one[1], block, alone, threshold):
                    held.append(found)
                    n += len(found[0])
                    if n >= TOGETHER:
                        yield out()
                        n = 0
        if held:
            yield out()

    # four partitions for each pair, as pairs that share one are met one after the other
    return met.drop("block", "other").select("pair", *(x.split(" ")[0] for x in _BLOCK.split(", ")[1:])).repartition(2 * n_blocks * (n_blocks + 1), "pair").sortWithinPartitions("pair").mapInArrow(meet, _EDGES)
