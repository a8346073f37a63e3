"""Bags as one row each, and the candidates of the near-miss join made from them without shuffling pairs.

A packed bag is the sorted 64-bit fingerprints of a form, then their counts. Texts are packed inside their row, whatever
comes as (form_id, fp, cnt) once it is grouped.

Candidates (for thresholds of at least SPLIT_FROM):

1. The n occurrences of a bag (a fingerprint and which time it is) are split by their hashes into G parts, G a power of two that follows n, so that
   a part has about PART of them. Where a pair reaches the threshold as a whole it does so in one part at least: else
   the sums of minima would be below the threshold times the sums of maxima. G is that of the pair's smaller bag, so a bag
   near a power of two is split in both ways.
2. Each part is posted under its rarest occurrences, as many as the threshold asks for. Rarity is the count of a slot
   of a table of fixed size: any order will do, as long as it is one order.
3. Postings carry 128 bits: the parity of the occurrences whose hash is that bit. Bits in which two parts
   differ are at most their occurrences that differ, so pairs that differ in too many are dropped where their postings meet, and
   only the others leave the task. Postings of equal bags are dropped there too: those are exact findings.
4. Fingerprints that very many forms have are dealt to blocks, and each pair of blocks is met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bags import SLACK

PACKED = "form_id bigint, kind string, bag_size bigint, bag_key string, trace_key string, bag binary"
#: Thresholds below this one are left to the join on keys: bits tell little there.
SPLIT_FROM = 0.5
PART = 128
SLOTS = 1 << 20
#: Forms that an occurrence may have before its postings are dealt to blocks.
BLOCK = 20_000
#: Postings that a task holds before it passes them on, and pairs that it looks at together.
HELD = 250_000
TOGETHER = 250_000
ROW = "bucket int, n int, data binary"
_PAIRS = "left_id bigint, left_size bigint, right_id bigint, right_size bigint"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=1)
_POSTING = {"key": np.uint64, "id": np.int64, "size": np.int64, "part": np.int32, "bag": np.uint64, "b0": np.uint64, "b1": np.uint64}
Rows = dict[str, np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# -- packing


@cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """(a digit for each byte of a token, that of its lower case); 0 for other bytes."""
    spelled = np.zeros(256, np.uint64)
    for c in range(128):
        if chr(c).isalnum():
            spelled[c] = c
    spelled = np.where(spelled > 0, mixed(spelled * _P) | np.uint64(1), np.uint64(0))
    lower = spelled.copy()
    lower[65:91] = spelled[97:123]
    return spelled, lower


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all ASCII tokens as spelled, in lower case, and the text of each)."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    spelled, lower = _digits()
    inside = np.flatnonzero(spelled[data])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.diff(inside, prepend=-2) > 1
    at = np.searchsorted(inside, ends[:-1])  # a token ends with its text
    begins[at[at < len(inside)]] = True
    first = np.flatnonzero(begins)
    size = np.diff(first, append=len(inside))
    power = np.full(int(size.max()), _P)
    power[0] = 1
    power = np.multiply.accumulate(power)[np.arange(len(inside)) - np.repeat(first, size)]
    code = data[inside]
    hashes = (mixed(np.add.reduceat(digit[code] * power, first)) for digit in (spelled, lower))
    return (*hashes, np.searchsorted(ends, inside[first], "right") - 1)


def counted(fp: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, count, row) of the fingerprints of rows, sorted by row and fingerprint."""
    order = np.lexsort((fp, of))
    fp, of = fp[order], of[order]
    head = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (of[1:] != of[:-1]))) if len(fp) else np.zeros(0, np.int64)
    return fp[head], np.diff(head, append=len(fp)), of[head]


def digest(*parts: bytes) -> str:
    h = hashlib.blake2b(digest_size=16)
    for x in parts:
        h.update(x)
    return h.hexdigest()


def squeezed(data: bytes) -> bytes:
    return _CODEC.compress(data, asbytes=True)


def plain(data: bytes, size: int) -> bytes:
    return _CODEC.decompress(data, size, asbytes=True)


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.uint32, n, 8 * n)


def packed_texts(rows: DataFrame, id_column: str, text_column: str, kind: Column) -> DataFrame:
    """PACKED forms of texts, a row each; those without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                spelled, lower, of = tokens(part.column(2))
                fp, cnt, row = counted(lower, of)
                keys = np.arange(part.num_rows + 1)
                cut, said = np.searchsorted(row, keys), np.searchsorted(of, keys)
                out = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    bag = fp[cut[k] : cut[k + 1]].tobytes() + cnt[cut[k] : cut[k + 1]].astype(np.uint32).tobytes()
                    out.append((k, int(said[k + 1] - said[k]), digest(bag), digest(spelled[said[k] : said[k + 1]].tobytes()), bag))
                if out:
                    at, size, key, trace, bag = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(size, pa.int64()), pa.array(key), pa.array(trace), pa.array(bag, pa.binary())], names=[x.split(" ")[0] for x in PACKED.split(", ")])

    return rows.select(F.col(id_column).cast("bigint").alias("id"), kind.cast("string").alias("kind"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, PACKED)


def packed_turns(rows: DataFrame, id_column: str, role_column: str, text_column: str, kind: Column) -> DataFrame:
    """PACKED forms of texts in several rows: fingerprints are lower-case tokens with their row's role, a null one being a role too. Traces aren't told apart."""
    own = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text")).where("id is not null and text is not null")
    own = own.groupBy("id").agg(F.collect_list(F.struct("role", "text")).alias("turns")).select("id", kind.cast("string").alias("kind"), "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles: dict[str | None, int] = {None: 0}
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                turns = part.column(2).flatten()
                said = turns.field("role").to_pylist()
                for x in set(said) - roles.keys():
                    roles[x] = int(digest(x.encode())[:16], 16) | 1
                form = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                _, lower, of = tokens(turns.field("text"))
                salt = np.array([roles[x] for x in said], np.uint64)[of]
                fp, cnt, row = counted(np.where(salt > 0, mixed(lower + salt), lower), form[of])
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                some = np.flatnonzero(np.diff(cut))
                bags = [fp[cut[k] : cut[k + 1]].tobytes() + cnt[cut[k] : cut[k + 1]].astype(np.uint32).tobytes() for k in some.tolist()]
                if bags:
                    size = np.add.reduceat(cnt, cut[some])
                    at = pa.array(some)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(size, pa.int64()), pa.array([digest(x) for x in bags]), pa.array([""] * len(bags)), pa.array(bags, pa.binary())], names=[x.split(" ")[0] for x in PACKED.split(", ")])

    return own.mapInArrow(run, PACKED)


def packed_bags(bag: DataFrame, remaining: DataFrame) -> DataFrame:
    """PACKED forms of (form_id, fp, cnt); ``remaining`` has form_id and kind."""
    fp = F.col("fp") if dict(bag.dtypes)["fp"] == "bigint" else F.xxhash64("fp")
    own = bag.groupBy("form_id").agg(F.collect_list(F.struct(fp.alias("fp"), F.col("cnt").cast("bigint").alias("cnt"))).alias("items")).join(remaining.select("form_id", "kind"), "form_id").select("form_id", "kind", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for items in b.column(2):
                fps, cnts = (items.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                order = np.argsort(fps.view(np.uint64))
                data = fps[order].tobytes() + cnts[order].astype(np.uint32).tobytes()
                out.append((int(cnts.sum()), digest(data), data))
            if out:
                size, key, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(key), pa.array([""] * len(key)), pa.array(data, pa.binary())], names=[x.split(" ")[0] for x in PACKED.split(", ")])

    return own.mapInArrow(run, PACKED)


# -- postings


def occurrences(fp: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """A hash of each occurrence: of its fingerprint and which time it is."""
    once = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    return mixed(np.repeat(mixed(fp + _P), cnt) + once.astype(np.uint64) * _P)


def slots_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(8)) & np.uint64(SLOTS - 1)).astype(np.int64)


def rarity(packed: DataFrame) -> np.ndarray:
    """For each slot how many forms have an occurrence of it, in steps of an eighth of a doubling; one byte each."""
    width = 16384

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                fps, cnts = zip(*(unpacked(x) for x in b.column(0).slice(lo, 256).to_pylist()), strict=True)
                n += np.bincount(slots_of(occurrences(np.concatenate(fps), np.concatenate(cnts).astype(np.int64))), minlength=SLOTS)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // width), pa.int32()), pa.array([squeezed(x.astype(np.uint32).tobytes()) for x in n.reshape(-1, width)], pa.binary())], names=["chunk", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(plain(data, 4 * width), np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        if sums:
            steps = [np.ceil(8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(steps, pa.binary())], names=["chunk", "data"])

    out = np.zeros((SLOTS // width, width), np.uint8)
    parts = packed.select("bag").mapInArrow(count, "chunk int, data binary").repartition("chunk").mapInArrow(add, "chunk int, data binary")
    for r in parts.collect():  # SLOTS bytes, whatever the table
        out[r["chunk"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def classes(size: np.ndarray) -> np.ndarray:
    """The logarithm of the number of parts of bags of this size."""
    return np.maximum(0, np.frexp(np.maximum(size, 1) / PART)[1] - 1)


def postings(ids: np.ndarray, kinds: list[str], bag_keys: list[str], bags: list[bytes], rare: np.ndarray, threshold: float) -> Rows:
    """The postings of bags that aren't empty."""
    pairs = [unpacked(x) for x in bags]
    n = np.array([len(f) for f, _ in pairs])
    fp, cnt = np.concatenate([f for f, _ in pairs]), np.concatenate([c for _, c in pairs]).astype(np.int64)
    size = np.add.reduceat(cnt, np.cumsum(n) - n)
    top, low = classes(size), classes(np.floor(size * threshold - SLACK))
    ways = top - low + 1
    doc = np.repeat(np.arange(len(bags)), ways)  # a bag for each number of parts
    way = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(ways) - ways, ways)
    m = n[doc]
    at = np.repeat((np.cumsum(n) - n)[doc] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    fp, cnt, of = fp[at], cnt[at], np.repeat(np.arange(len(doc)), m)
    h, of = occurrences(fp, cnt), np.repeat(of, cnt)
    steps = rare[slots_of(h)]
    part = (h >> np.uint64(44)) & ((np.uint64(1) << way.astype(np.uint64)) - np.uint64(1))[of]
    order = np.lexsort((h, steps, part, of))
    of, h, part, steps = (x[order] for x in (of, h, part, steps))
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1])))
    mass = np.diff(head, append=len(h))
    one = np.uint64(1) << (h & np.uint64(63))
    second = (h >> np.uint64(6)) & np.uint64(1) == 1
    b0, b1 = (np.bitwise_xor.reduceat(np.where(x, one, np.uint64(0)), head) for x in (~second, second))
    need = mass - np.ceil(mass * threshold - SLACK).astype(np.int64) + 1
    seg = np.repeat(np.arange(len(head)), mass)
    keep = np.flatnonzero(np.arange(len(h)) - np.repeat(head, mass) < need[seg])
    seg, of = seg[keep], of[keep]
    kind = np.array([int(digest(x.encode())[:15], 16) for x in kinds], np.uint64)
    bag = np.array([int(x[:16], 16) for x in bag_keys], np.uint64)
    d = doc[of]
    key = mixed(h[keep] ^ mixed(kind[d] + way[of].astype(np.uint64)))
    rows = {"key": key, "id": ids[d], "size": size[d], "part": mass[seg].astype(np.int32), "bag": bag[d], "b0": b0[seg], "b1": b1[seg]}
    blocks = np.ceil(2 ** (steps[keep] / 8) / BLOCK).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return rows
    times = blocks[hot]
    own = np.repeat(mixed(rows["bag"][hot]) % times.astype(np.uint64), times)
    other = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    many = {c: np.repeat(v[hot], times) for c, v in rows.items()}
    many["key"] = mixed(many["key"] + mixed(np.minimum(own, other) << np.uint64(32) | np.maximum(own, other)))
    cold = np.flatnonzero(blocks <= 1)
    return {c: np.concatenate([v[cold], many[c]]) for c, v in rows.items()}


def _written(rows: Rows) -> bytes:
    planes = (np.ascontiguousarray(np.ascontiguousarray(rows[c], t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes() for c, t in _POSTING.items())
    return squeezed(b"".join(planes))


def _read(parts: list[tuple[int, bytes]]) -> Rows:
    out: dict[str, list[np.ndarray]] = {c: [] for c in _POSTING}
    width = sum(np.dtype(t).itemsize for t in _POSTING.values())
    for n, data in parts:
        at, data = 0, plain(data, width * n)
        for c, t in _POSTING.items():
            size = np.dtype(t).itemsize * n
            out[c].append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(-1, n).T).view(t).ravel())
            at += size
    return {c: np.concatenate(v) for c, v in out.items()}


def met(rows: Rows, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(left_id, left_size, right_id, right_size), perhaps repeated, of postings that share a key and may reach the threshold; left is the smaller by (size, id)."""
    order = np.lexsort((rows["id"], rows["bag"], rows["key"]))
    key, bag = rows["key"][order], rows["bag"][order]
    same = (key[1:] == key[:-1]) & (bag[1:] == bag[:-1])
    order = order[~(np.append(False, same) | np.append(same, False))]
    order = order[np.lexsort((rows["part"][order], rows["key"][order]))]
    rows = {c: v[order] for c, v in rows.items()}
    if not len(order):
        return
    rank = np.cumsum(np.append(False, rows["key"][1:] != rows["key"][:-1])).astype(np.int64) << 32
    upto = np.searchsorted(rank | rows["part"], rank | np.floor(rows["part"] / threshold + 1e-6).astype(np.int64), "right")
    n = upto - np.arange(len(order)) - 1
    total = np.cumsum(n)
    loose = (1 - threshold) / (1 + threshold)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TOGETHER, "right")))
        a = np.repeat(np.arange(lo, hi), n[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        differ = np.bitwise_count(rows["b0"][a] ^ rows["b0"][b]).astype(np.int32) + np.bitwise_count(rows["b1"][a] ^ rows["b1"][b])
        ok = np.flatnonzero(differ <= (rows["part"][a].astype(np.int64) + rows["part"][b]) * loose + 1e-6)
        a, b = a[ok], b[ok]
        small, large = np.minimum(rows["size"][a], rows["size"][b]), np.maximum(rows["size"][a], rows["size"][b])
        ok = small >= large * threshold - 1e-6
        a, b = a[ok], b[ok]
        swap = (rows["size"][a] > rows["size"][b]) | ((rows["size"][a] == rows["size"][b]) & (rows["id"][a] > rows["id"][b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        if len(a):
            yield rows["id"][a], rows["size"][a], rows["id"][b], rows["size"][b]
        lo = hi


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    head = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])) if len(left) else np.zeros(0, bool)
    return left[head], right[head]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _column(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8 * n * at).reshape(8, n).T).view(np.int64).ravel()


def _pair_rows(left: np.ndarray, right: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Distinct pairs, packed, by the bucket of the left form."""
    left, right = _distinct(left, right)
    bucket = (mixed(left.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    left, right, bucket = left[order], right[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    data = [squeezed(_planes(np.diff(left[lo:hi], prepend=0)) + _planes(right[lo:hi])) for lo, hi in spans]
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[lo]) for lo, _ in spans], pa.int32()), pa.array([hi - lo for lo, hi in spans], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "n", "data"])


def _pairs_read(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    held = [(plain(data, 16 * n), n) for n, data in parts]
    return _distinct(np.concatenate([np.cumsum(_column(d, n, 0)) for d, n in held]), np.concatenate([_column(d, n, 1) for d, n in held]))


def packed_candidates(packed: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id): pairs of unequal bags of one kind that may reach the threshold, each once; left is the smaller by (size, id)."""
    rare = rarity(packed)
    buckets = max(256, 8 * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(held: list[Rows]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([x[c] for x in held]) for c in _POSTING}
        rows = {c: v[order] for order in [np.argsort(rows["key"])] for c, v in rows.items()}
        bucket = ((rows["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        spans = [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        data = [_written({c: v[lo:hi] for c, v in rows.items()}) for lo, hi in spans]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[lo]) for lo, _ in spans], pa.int32()), pa.array([hi - lo for lo, hi in spans], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "n", "data"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                ids, kinds, keys, bags = (c.to_pylist() for c in b.slice(lo, 128).columns)
                held.append(postings(np.array(ids, np.int64), ["" if x is None else f"={x}" for x in kinds], keys, bags, rare, threshold))
                n += len(held[-1]["key"])
                if n >= HELD:
                    yield from dealt(held)
                    held, n = [], 0
        if held:
            yield from dealt(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for parts in _by_bucket(batches):
            for left, _, right, _ in met(_read(parts), threshold):
                found.append((left, right))
                n += len(left)
                if n >= 2 * HELD:
                    found[:] = [_distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    n = len(found[0][0])
                    if n >= HELD:
                        yield _pair_rows(*found.pop(), buckets)
                        n = 0
        if found:
            yield _pair_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_bucket(batches):
            left, right = _pairs_read(parts)
            for lo in range(0, len(left), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 20_000], pa.int64()) for x in (left, right)], names=["left_id", "right_id"])

    rows = packed.select("form_id", "kind", "bag_key", "bag").mapInArrow(post, ROW)
    pairs = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, ROW)
    return pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(once, "left_id bigint, right_id bigint")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    parts: list[tuple[int, bytes]] = []
    now = None
    for b in batches:
        for bucket, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if now != bucket and parts:
                yield parts
                parts = []
            now = bucket
            parts.append((n, data.as_py()))
    if parts:
        yield parts


def jaccard(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> float:
    """Sum of minima over sum of maxima of two bags: fingerprints, counts and size of each."""
    (fa, ca, na), (fb, cb, nb) = a, b
    at = np.minimum(np.searchsorted(fb, fa), len(fb) - 1)
    hit = np.flatnonzero(fb[at] == fa)
    common = int(np.minimum(ca[hit], cb[at[hit]]).sum())
    return common / (na + nb - common)


#: Pairs of a group that one task scores.
GROUP = 20_000


def packed_scores(pairs: DataFrame, bags: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(left_id, left_size, right_id, right_size, score) of ``pairs``; ``bags`` has form_id and bag.

    Pairs are grouped by the least form that their left one is paired with, so near copies of one another are in few groups, and a bag is sent
    once for each group it is in, not for each pair. Groups of many pairs are cut by both forms.
    """
    ends = pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).union(pairs.select(F.col("right_id").alias("a"), F.col("left_id").alias("b")))
    label = keep(ends.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")))
    named = keep(pairs.join(label.withColumnRenamed("a", "left_id"), "left_id"))
    sizes = named.groupBy("label").agg(F.ceil(F.sqrt(F.count("*") / GROUP)).cast("int").alias("cuts"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    grouped = keep(named.join(keep(sizes), "label").select(F.xxhash64("label", cut("left_id"), cut("right_id")).alias("grp"), "left_id", "right_id"))
    there = grouped.select("grp", F.explode(F.array("left_id", "right_id")).alias("form_id")).distinct()
    sent = there.join(bags.hint("merge"), "form_id").select("grp", F.col("form_id").alias("left_id"), F.lit(None).cast("bigint").alias("right_id"), "bag")
    rows = sent.union(grouped.select("grp", "left_id", "right_id", F.lit(None).cast("binary").alias("bag")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        now, out = None, []
        for b in batches:
            for group, left, right, bag in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if group != now:
                    now, held = group, {}
                if right is None:
                    fp, cnt = unpacked(bag.as_py())
                    held[left] = fp, cnt, int(cnt.sum())
                    continue
                x, y = held[left], held[right]
                out.append((left, x[2], right, y[2], jaccard(x, y)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.float64()), strict=True)], names=[x.split(" ")[0] for x in f"{_PAIRS}, score".split(", ")])
                out = []

    return rows.repartition("grp").sortWithinPartitions("grp", F.col("right_id").asc_nulls_first()).mapInArrow(run, f"{_PAIRS}, score double")


#: Slots, a bit each, of the table that tells rows which are not asked for.
ASKED = 1 << 23


def _asked_slots(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64) + _P) % np.uint64(ASKED)).astype(np.int64)


def bags_of(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(form_id, bag) of the forms of ``wanted``. A table of bits of fixed size lets most others go before the join, so they aren't shuffled."""
    width = 8192

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ASKED, bool)
        for b in batches:
            bits[_asked_slots(b.column(0).to_numpy(zero_copy_only=False))] = True
        chunks = np.packbits(bits).reshape(-1, width)
        some = np.flatnonzero(chunks.any(axis=1)).tolist()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([squeezed(chunks[k].tobytes()) for k in some], pa.binary())], names=["chunk", "data"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(plain(data, width), np.uint8)
                sums[chunk] = sums[chunk] | x if chunk in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "data"])

    table = np.zeros((ASKED // 8 // width, width), np.uint8)
    for r in wanted.select("form_id").mapInArrow(mark, "chunk int, data binary").repartition("chunk").mapInArrow(either, "chunk int, data binary").collect():  # at most a bit for each slot
        table[r["chunk"]] = np.frombuffer(r["data"], np.uint8)
    held = table.tobytes()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held, np.uint8)
        for b in batches:
            at = _asked_slots(b.column(0).to_numpy(zero_copy_only=False))
            out = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            if out.num_rows:
                yield out

    return packed.select("form_id", "bag").mapInArrow(some, "form_id bigint, bag binary").join(wanted.select("form_id"), "form_id", "left_semi")
