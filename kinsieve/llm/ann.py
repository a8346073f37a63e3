"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt to shards by hash, a shard a partition. In each shard a directed
graph is built: greedy searches from the entry propose neighbours of each vector, and
relaxed pruning keeps a neighbour only if no kept one is closer to it by the factor ALPHA, so
that edges stay diverse. Each query walks every shard's graph by beam search; what the
beams hold is scored exactly, and the shards' best are merged.

A shard has at least SHARD vectors (or all), as many as give each core two shards, and at most MOST, which
is what a task holds with its graph: until all shards are that large, more rows make larger shards, not more
searches. Beams widen with the root of a shard's size, which keeps the recall. Queries
stream past a shard's graph, so a task never holds them all.

Equal vectors are one node, with the smallest vec_ids kept for it (K + 1 are enough for
any query), so a vector that fills a third of the table costs one node and is found whole.

Defined results for odd input: vectors that are null, empty, zero, or hold null or
non-finite components take no part; vectors are compared with those of their own length only;
rows that repeat a vec_id count as one candidate; rows with a null vec_id take no part;
an empty table gives no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SHARD = 4096
MOST = 65_536
DEGREE = 28
BEAM = 64
WIDTH = 4
ALPHA = 1.2
BATCH = 256
SEED = 20
#: Distinct vectors that a task holds while it looks for copies.
HELD = 20_000


def distances(q: np.ndarray, x: np.ndarray, x2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, from each row of q to its rows of ids; infinite for -1."""
    at = np.maximum(ids, 0)
    d = x2[at] - 2 * np.matmul(x[at], q[:, :, None])[:, :, 0]
    d[ids < 0] = np.inf
    return d


def beam_search(q: np.ndarray, x: np.ndarray, x2: np.ndarray, edges: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """The ids that each query's beam ends with, nearest first; -1 where there are fewer."""
    rows = len(q)
    ids = np.full((rows, beam), -1, np.int64)
    start = entry[:beam]
    ids[:, : len(start)] = start
    dist = distances(q, x, x2, ids)
    open_ = ids >= 0
    while True:
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            break
        b, d, o = ids[live], dist[live], open_[live]
        pick = np.argsort(np.where(o, d, np.inf), axis=1, kind="stable")[:, :WIDTH]
        r = np.arange(len(live))[:, None]
        chosen = np.where(o[r, pick], b[r, pick], -1)
        o[r, pick] = False
        new = np.where(chosen[:, :, None] >= 0, edges[np.maximum(chosen, 0)], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new[:, :, None] == b[:, None, :]).any(2)] = -1
        far = distances(q[live], x, x2, new)
        b, d, o = np.hstack([b, new]), np.hstack([d, far]), np.hstack([o, new >= 0])
        best = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], open_[live] = b[r, best], d[r, best], o[r, best]
    return ids


def robust_prune(own: np.ndarray, cand: np.ndarray, x: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each own vector at most ``degree`` of its candidates (-1: none), the nearest first; one is dropped if a kept one is closer to it."""
    cand = cand.copy()
    cand[cand == own[:, None]] = -1
    cand.sort(axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    d = ((v - x[own][:, None, :]) ** 2).sum(2)
    d[cand < 0] = np.inf
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1, np.int64)
    left, r = d.copy(), np.arange(len(own))
    for k in range(degree):
        p = left.argmin(1)
        ok = np.isfinite(left[r, p])
        if not ok.any():
            break
        out[ok, k] = cand[r, p][ok]
        covered = alpha * alpha * between[r, p] <= d
        left[covered] = np.inf
        left[r, p] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) over the rows of x, which are distinct."""
    n = len(x)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    x2 = (x * x).sum(1)
    medoid = int((((x - x.mean(0)) ** 2).sum(1)).argmin()) if n else 0
    entry = np.unique(np.concatenate([[medoid], rng.choice(n, min(n, 8), replace=False)])) if n else np.zeros(0, np.int64)
    edges = np.full((n, degree), -1, np.int64)
    if n > 1:
        picks = rng.integers(0, n, (n, min(degree, 12)))
        edges[:, : picks.shape[1]] = np.where(picks == np.arange(n)[:, None], -1, picks)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            own = order[i : i + BATCH]
            found = beam_search(x[own], x, x2, edges, entry, beam)
            edges[own] = robust_prune(own, np.hstack([found, edges[own]]), x, a, degree)
            # edges back; lists that overflow are pruned again
            src, dst = np.repeat(own, degree), edges[own].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            heads, first, times = np.unique(dst, return_index=True, return_counts=True)
            more = np.full((len(heads), int(times.max(initial=0))), -1, np.int64)
            more[np.repeat(np.arange(len(heads)), times), np.arange(len(dst)) - np.repeat(first, times)] = src
            for j in range(0, len(heads), BATCH):
                h = heads[j : j + BATCH]
                edges[h] = robust_prune(h, np.hstack([edges[h], more[j : j + BATCH]]), x, a, degree)
    return edges, entry


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((v - q) ** 2).sum(-1))


class Shard:
    """The graph over distinct vectors of one length; ``ids`` are the candidates that each stands for."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], k: int = K):
        order = np.lexsort((*vectors.T[::-1], [min(x) for x in ids]))
        self.vectors, self.ids, self.k = vectors[order], [ids[i] for i in order.tolist()], k
        self.edges, self.entry = build_graph(self.vectors)
        self.x = self.vectors.astype(np.float32)
        self.x2 = (self.x * self.x).sum(1)
        self.beam = max(2 * k, int(BEAM * max(1.0, len(vectors) / SHARD) ** 0.5))

    def search(self, queries: np.ndarray, query_ids: list[int]) -> Iterator[tuple[int, int, float]]:
        """The k nearest candidates of each query: (query_id, vec_id, score)."""
        for i in range(0, len(queries), BATCH):
            q = queries[i : i + BATCH]
            beams = beam_search(q.astype(np.float32), self.x, self.x2, self.edges, self.entry, self.beam)
            for own, point, found in zip(query_ids[i : i + BATCH], q, beams, strict=True):
                found = found[found >= 0]
                near = exact(point, self.vectors[found])
                best = sorted((s, c) for s, f in zip(near.tolist(), found.tolist(), strict=True) for c in self.ids[f] if c != own)[: self.k]
                yield from ((own, c, s) for s, c in best)


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) from rows in order of (shard, dim, kind): a shard's vectors (kind 0), then the queries (kind 1)."""
    now: tuple[int, int] | None = None
    held: list[tuple[np.ndarray, list[list[int]]]] = []
    graph: Shard | None = None
    for b in batches:
        shard, dim, kind = (b.column(c).to_numpy() for c in range(3))
        cuts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(dim, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            at = (int(shard[lo]), int(dim[lo]))
            if at != now:
                now, held, graph = at, [], None
            part = b.slice(lo, hi - lo)
            vectors = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            if not kind[lo]:
                held.append((vectors.copy(), part.column(5).to_pylist()))
                continue
            if held:
                graph = Shard(np.concatenate([v for v, _ in held]), [i for _, ids in held for i in ids], k)
                held = []
            if graph is None:  # no vectors of this length here
                continue
            rows = list(graph.search(vectors, part.column(3).to_pylist()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def valid(vector: Column) -> Column:
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda c: c != 0)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector with its k + 1 smallest ids. Partitions are thinned before the shuffle, so copies cost little."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            vectors = [np.frombuffer(v, np.float64) for v in kept]
            ids = [sorted(set(g))[: k + 1] for g in kept.values()]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))], names=["vector", "ids"])

        for b in batches:
            own, values, ends = b.column(0).to_pylist(), b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()
            at = 0
            for i, end in zip(own, ends, strict=True):
                got = kept.setdefault(values[at:end].tobytes(), [])
                at = end
                got.append(i)
                if len(got) > 64:
                    got[:] = sorted(set(got))[: k + 1]
            if len(kept) > HELD:
                yield out()
        if kept:
            yield out()

    part = rows.select("vec_id", "vector").mapInArrow(thin, "vector array<double>, ids array<bigint>")
    return part.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def shards_for(rows: int, cores: int, least: int = SHARD, most: int = MOST) -> int:
    """How many shards ``rows`` vectors are dealt to."""
    return max(1, -(-rows // most), min(round(rows / least), 2 * cores))


def nearest(base: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``base``; both have vec_id and embedding."""
    prepare = lambda df: df.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0)).alias("vector"))  # noqa: E731  -0.0 becomes 0.0
    rows, asked = prepare(base), prepare(queries)
    shards = shards_for(rows.count(), base.sparkSession.sparkContext.defaultParallelism, shard, most)
    dim = F.size("vector").alias("dim")
    deal = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard")
    vectors = distinct_vectors(rows, k).select(deal, dim, F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("vec_id"), "vector", "ids")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    spread = asked.dropDuplicates(["vec_id"]).select(every, dim, F.lit(1).alias("kind"), "vec_id", "vector", F.lit(None).cast("array<bigint>").alias("ids"))
    # a shard is little data but much work, so each gets a partition of its own
    dealt = vectors.union(spread).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id")
    found = dealt.mapInArrow(lambda batches: searched(batches, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
