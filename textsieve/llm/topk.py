"""Exact top-k inner products, pruned with segment means and deviations from coarse to fine.

A vector is cut into segments; with each segment's mean and the norm of its deviations from it, the
inner product is at most the sum of m * mean * mean + deviation * deviation over segments of length
m (Cauchy-Schwarz on the deviations). Candidates whose bound at a resolution is below a query's
k-th best score so far are dropped; survivors go to the next resolution, and at last to the exact
integer product. Queries are read in blocks of bounded size, each broadcast against all rows; a
task keeps k rows per query, and the k best of all tasks are ranked.

Edge cases: vectors that are null, hold null or non-finite components, or have no id take no part;
vectors of different length are not compared; candidates of the query's id are its own and left
out; equal candidate rows each count; a query id met with several vectors uses the smallest one.
Scores outside the range of a long are clipped to it. No queries or no candidates give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a broadcast block, and queries compared at once inside a task.
QUERY_BLOCK, AT_ONCE = 16_384, 1_024
_LOW = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """Whether a vector has finite components only, also after scaling."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers: int64, or Python integers where those are too small."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(scaled)


def resolutions(n: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has segments of at least four components."""
    return [s for s in (1, 4, 16, 64, 256) if s == 1 or n // s >= 4] if n else []


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per segment: mean times root of length, then norm of deviations; rows multiply to the bound."""
    values = vectors.astype(np.float64)
    edges = np.linspace(0, values.shape[1], segments + 1).astype(int)
    means, norms = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = values[:, a:b]
        mean = part.mean(axis=1)
        means.append(mean * math.sqrt(b - a))
        norms.append(np.sqrt(np.square(part - mean[:, None]).sum(axis=1)))
    return np.stack(means + norms, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``, clipped to long."""
    top = _top(a) * _top(b) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LOW, 2**63 - 1).astype(np.int64)


def _top(a: np.ndarray) -> int:
    return int(np.abs(a).max()) if a.size else 0


class Best:
    """The k best candidates of some queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), _LOW)
        self.found = np.zeros((len(ids), k), np.int64)
        self.held = np.zeros((len(ids), k), bool)
        self.bounds = [statistics(vectors, s) for s in resolutions(vectors.shape[1])]

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        bounds = [statistics(vectors, s) for s in resolutions(vectors.shape[1])]
        first = 0
        while first < len(ids):  # a small first part sets thresholds for the larger ones
            last = first + (64 if not self.held.all() else 2048)
            for a in range(0, len(self.ids), AT_ONCE):
                self._offer(slice(a, a + AT_ONCE), ids[first:last], vectors[first:last], [x[first:last] for x in bounds])
            first = last

    def _offer(self, own: slice, ids: np.ndarray, vectors: np.ndarray, bounds: list[np.ndarray]) -> None:
        worst = np.where(self.held[own].all(axis=1), self.score[own].min(axis=1), _LOW)
        alive = self.ids[own][:, None] != ids[None, :]
        for mine, theirs in zip(self.bounds, bounds, strict=True):
            rows = np.flatnonzero(alive.any(axis=0))
            most = mine[own] @ theirs[rows].T
            most += 1e-9 * np.abs(most) + 1.0  # rounding never drops a candidate
            alive[:, rows] &= most >= worst[:, None].astype(np.float64)
        rows = np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return
        scores = products(self.vectors[own], vectors[rows])
        q, c = np.nonzero(alive[:, rows] & (scores >= worst[:, None]))
        if not len(q):
            return
        held_q, held_c = np.nonzero(self.held[own])
        query = np.concatenate([q, held_q])
        score = np.concatenate([scores[q, c], self.score[own][held_q, held_c]])
        found = np.concatenate([ids[rows][c], self.found[own][held_q, held_c]])
        by = np.lexsort((found, ~score, query))
        query, score, found = query[by], score[by], found[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        query, place = query[keep] + own.start, place[keep]
        self.score[query, place], self.found[query, place] = score[keep], found[keep]
        self.held[query, place] = True


def _by_length(ids: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum(lengths)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield ids[at], values[(ends[at] - n)[:, None] + np.arange(n)]


def _search(queries, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(ids, vectors, k) for ids, vectors in queries.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for some, vectors in _by_length(ids, lengths, quantised(values, scale)):
                for b in best:
                    if b.vectors.shape[1] == vectors.shape[1]:
                        b.offer(some, vectors)
        for b in best:
            q, c = np.nonzero(b.held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids[q]), pa.array(b.found[q, c]), pa.array(b.score[q, c])], ["query_id", "vec_id", "score"]
            )

    return run


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Each query's ``k`` best other rows: ``query_id, rank, vec_id, score``; ties to the smaller id."""
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull())
    queries = rows.where(is_query).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    candidates = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for block in range(blocks):  # one block is in the driver at a time
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        lengths = np.asarray([len(v) for v in own["v"]], np.int64)
        flat = np.concatenate([np.asarray(v, np.float64) for v in own["v"]]) if len(own) else np.empty(0)
        data = list(_by_length(own["id"].to_numpy(np.int64), lengths, quantised(flat, scale)))
        held = vectors.sparkSession.sparkContext.broadcast(data)
        part = candidates.mapInArrow(_search(held, k, scale), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
