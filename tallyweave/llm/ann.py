"""Approximate nearest neighbours by collision counting (operator 1).

An index holds one sorted array for each of m Gaussian projections. A query opens a window around its own projection in
every array; the windows grow by a constant factor (virtual rehashing: wider windows of the same arrays are the coarser
hash tables). A vector in at least the threshold's number of windows is verified by its exact distance. The growth ends
for a query once a vector as near as its kth verified one would by now have passed the threshold with probability
1 - miss; no candidate is capped.

Rows are indexed where they are read, in shards of bounded size: nothing is shuffled but each shard's k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import best_of, by_dim, cut, own_rows, query_blocks, read, vectors


def reach_ratio(m: int, threshold: int, miss: float) -> float:
    """The half-width, in distances, at which a vector is under the threshold with probability miss at most."""

    def under(p: float) -> float:
        return sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(p) + (m - i) * math.log1p(-p)) for i in range(threshold))

    lo, hi = 1e-3, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = min(max(math.erf(mid / math.sqrt(2)), 1e-12), 1 - 1e-12)
        lo, hi = (mid, hi) if under(p) > miss else (lo, mid)
    return hi


class CollisionIndex:
    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int, threshold: int, miss: float, growth: float, seed: int) -> None:
        self.ids, self.x, self.threshold, self.growth = ids, x, threshold, growth
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], m))
        p = x @ self.a
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T).astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, self.order.T.astype(np.int64), axis=0).T)
        self.ratio = reach_ratio(m, threshold, miss)
        self.first = max(float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) / 64, 1e-300)

    def search(self, asked: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in asked, id, distance) of each query's k nearest found."""
        n, m = len(self.ids), len(self.sorted)
        centre = (q @ self.a).T
        r, c = own_rows(asked, self.ids)
        itself: dict[int, list[int]] = {}
        for row, at in zip(r, c, strict=True):
            itself.setdefault(int(at), []).append(int(row))
        counts = np.zeros((len(q), n), np.int16)
        lo = np.stack([np.searchsorted(self.sorted[j], centre[j]) for j in range(m)])
        hi = lo.copy()
        seen = np.zeros((len(q), n), bool)
        for at, rows in itself.items():
            seen[at, rows] = True
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0)) for _ in q]
        live, half = np.arange(len(q)), self.first
        while len(live):
            new_lo = np.stack([np.searchsorted(self.sorted[j], centre[j, live] - half, "left") for j in range(m)])
            new_hi = np.stack([np.searchsorted(self.sorted[j], centre[j, live] + half, "right") for j in range(m)])
            new_lo, new_hi = np.minimum(new_lo, lo[:, live]), np.maximum(new_hi, hi[:, live])
            still = []
            for i, at in enumerate(live):
                more = [self.order[j, new_lo[j, i] : lo[j, at]] for j in range(m)] + [self.order[j, hi[j, at] : new_hi[j, i]] for j in range(m)]
                counts[at] += np.bincount(np.concatenate(more), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((counts[at] >= self.threshold) & ~seen[at])
                if len(fresh):
                    seen[at, fresh] = True
                    d = self.x[fresh] - q[at]
                    rows = np.concatenate([found[at][0], fresh])
                    d = np.concatenate([found[at][1], np.sqrt(np.einsum("ij,ij->i", d, d))])
                    best = np.lexsort((self.ids[rows], d))[:k]
                    found[at] = (rows[best], d[best])
                whole = (new_lo[:, i] == 0).all() and (new_hi[:, i] == n).all()
                if not whole and not (len(found[at][0]) == k and half >= self.ratio * found[at][1][-1]):
                    still.append(at)
            lo[:, live], hi[:, live] = new_lo, new_hi
            live, half = np.array(still, np.int64), half * self.growth
        at = np.repeat(np.arange(len(q)), [len(f[0]) for f in found])
        rows = np.concatenate([f[0] for f in found])
        return at, self.ids[rows], np.concatenate([f[1] for f in found])


def nearest(
    df: DataFrame, k: int = 10, every: int = 100, projections: int = 64, threshold: int = 32, miss: float = 0.03, growth: float = 1.3, shard_rows: int = 8192, block_rows: int = 8192, at_once: int = 512, seed: int = 17, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, ties to smaller ids.

    Queries are the rows whose id is divisible by every; candidates are all rows with another id and as many components.
    Null ids and vectors, empty and zero vectors and ones that hold null or non-finite components take no part. Fewer
    than k candidates give fewer rows. Rows that repeat an id are listed as often as they occur; a query that repeats asks
    once. An empty table gives an empty one. Distances are exact, on the original vectors; recall is what is approximate.
    """
    spark = df.sparkSession
    sc, vecs, out = spark.sparkContext, vectors(df, id_col, vec_col), []
    for own in query_blocks(vecs, every, block_rows, True):
        block = sc.broadcast(own)  # at most 2 * block_rows vectors

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            asked = block.value
            held: dict[int, list] = {}
            kept: dict[int, tuple] = {}

            def settle(n: int) -> None:
                ids, x = (np.concatenate(p) for p in zip(*held.pop(n), strict=True))
                index, parts = CollisionIndex(ids, x, projections, threshold, miss, growth, seed), []
                for i in range(0, len(asked[n][0]), at_once):  # one index for all of the block, counters for a part of it
                    at, found, d = index.search(asked[n][0][i : i + at_once], asked[n][1][i : i + at_once], k)
                    parts.append((at + i, found, d))
                new = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                new = tuple(np.concatenate(p) for p in zip(kept[n], new, strict=True)) if n in kept else new
                best = best_of(new[0], new[2], new[1], k)
                kept[n] = tuple(p[best] for p in new)

            for b in batches:
                for ids, x in by_dim(b, True):
                    n = x.shape[1]
                    for i in range(0, len(ids) if n in asked else 0, shard_rows):
                        held.setdefault(n, []).append((ids[i : i + shard_rows], x[i : i + shard_rows]))
                        if sum(len(h[0]) for h in held[n]) >= shard_rows:
                            settle(n)
            for n in list(held):
                settle(n)
            for n, (at, ids, d) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(asked[n][0][at], pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

        out.append(vecs.mapInArrow(run, "query_id long, vec_id long, score double"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(out) > 32:
        out = [cut(reduce(DataFrame.union, out[i : i + 32]), "ann") for i in range(0, len(out), 32)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.union, out).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth one."""
    return nearest(read(spark, sf_dir, "embeddings"))
