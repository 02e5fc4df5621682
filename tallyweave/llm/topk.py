"""Exact top-k by inner product with distributed histogram selection (operator 7).

Every candidate is scored against a block of queries. Instead of moving scores, each round moves histograms: every task
counts its scores in equal bins of the interval that still holds a query's kth score, the global sums show the bin with
the kth score, and that bin is the next interval, until it is one integer wide. A last pass keeps the rows that reach the
kth score and breaks ties by the smaller id. No round keeps more than a block's histograms in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import best_of, by_dim, cut, own_rows, query_blocks, read, vectors

BINS = 512
#: Scores are longs; one beyond them counts as the largest or smallest.
MOST = 2**63 - 1
_NONE = np.iinfo(np.int64).min


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -1e300, 1e300)


def score(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact: in doubles where every partial sum is under 2^53, in int64 under 2^62, and for the
    rows or queries that go beyond in whole numbers of any size."""
    if not c.size or not q.size:
        return np.zeros((len(c), len(q)), np.int64)
    rows, cols = np.abs(c).max(axis=1), np.abs(q).max(axis=1)
    n = c.shape[1]
    if rows.max() * cols.max() * n < 2.0**53:
        return (c @ q.T).astype(np.int64)
    if rows.max() * cols.max() * n < 2.0**62 and max(rows.max(), cols.max()) < 2.0**62:
        return c.astype(np.int64) @ q.astype(np.int64).T
    fine_r, fine_c = rows < 2.0**20, cols < 2.0**20  # products of these stay small
    out = np.empty((len(c), len(q)), np.int64)
    if fine_r.any() and fine_c.any():
        out[np.ix_(fine_r, fine_c)] = score(c[fine_r], q[fine_c])
    whole = np.frompyfunc(int, 1, 1)
    big = np.frompyfunc(lambda v: max(-MOST, min(MOST, v)), 1, 1)
    if not fine_r.all():
        out[~fine_r] = big(whole(c[~fine_r]) @ whole(q).T).astype(np.int64)
    if fine_r.any() and not fine_c.all():
        out[np.ix_(fine_r, ~fine_c)] = big(whole(c[fine_r]) @ whole(q[~fine_c]).T).astype(np.int64)
    return out


def _scores(batches: Iterator[pa.RecordBatch], block: dict, scale: float, rows: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, scores) in slices; a query's own row scores _NONE."""
    for b in batches:
        for ids, x in by_dim(b, False):
            n = x.shape[1]
            if n not in block:
                continue
            y = quantise(x, scale)
            for i in range(0, len(ids), rows):
                s = score(y[i : i + rows], block[n][1])
                r, c = own_rows(block[n][0], ids[i : i + rows])
                s[r, c] = _NONE
                yield n, ids[i : i + rows], s


def _histograms(vecs: DataFrame, block, spans, scale: float, k: int) -> DataFrame:
    """(dim, q, bin, n): how many scores of query q lie in each bin, bins counted from the top of its interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, span = block.value, spans.value
        total = {n: np.zeros((len(x[0]), BINS), np.int64) for n, x in own.items()}
        for n, _, s in _scores(batches, own, scale):
            lo, last, width = span[n]
            inside = (s >= lo) & (s <= last)
            at = ((s.view(np.uint64) - lo.view(np.uint64)) // width).astype(np.int64)  # distances may need all 64 bits
            q = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            total[n] += np.bincount((q[inside] * BINS + (BINS - 1 - at[inside])).astype(np.int64), minlength=total[n].size).reshape(total[n].shape)
        for n, t in total.items():
            before = np.cumsum(t, axis=1) - t
            q, b = np.nonzero((t > 0) & (before < k))  # below its own kth a task can't hold the global kth
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n), pa.int64()), pa.array(q, pa.int64()), pa.array(b, pa.int64()), pa.array(t[q, b], pa.int64())], ["dim", "q", "bin", "n"])

    return vecs.mapInArrow(run, "dim long, q long, bin long, n long").groupBy("dim", "q", "bin").agg(F.sum("n").alias("n"))


def _finish(vecs: DataFrame, block, least, scale: float, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = block.value, least.value
        kept: dict[int, tuple] = {}
        for n, ids, s in _scores(batches, own, scale):
            r, c = np.nonzero((s >= floor[n]) & (s != _NONE))
            new = (c, s[r, c], ids[r])
            new = tuple(np.concatenate(p) for p in zip(kept[n], new, strict=True)) if n in kept else new
            at = best_of(new[0], -new[1], new[2], k)
            kept[n] = tuple(p[at] for p in new)
        for n, (c, s, ids) in kept.items():
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(own[n][0][c], pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return vecs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(scale * x) for each query, ties to smaller ids.

    Queries are the rows whose id is divisible by every; candidates are all rows with another id and as many components.
    Null ids and vectors, empty vectors and ones that hold null or non-finite components take no part. A score beyond 64
    bits counts as the largest or smallest long. Fewer than k candidates give fewer rows. Rows that repeat an id with one
    vector are listed as often as they occur; a query that repeats asks once. An empty table gives an empty one; other
    columns, whatever their names, are not looked at.
    """
    spark = df.sparkSession
    sc, vecs, out = spark.sparkContext, vectors(df, id_col, vec_col), []

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for b in batches:
            for _, x in by_dim(b, False):
                with np.errstate(over="ignore"):
                    most[x.shape[1]] = max(most.get(x.shape[1], 0), float((quantise(x, scale) ** 2).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["dim", "most"])

    largest = {r.dim: r.most**0.5 for r in vecs.mapInArrow(extent, "dim long, most double").groupBy("dim").agg(F.max("most").alias("most")).collect()}
    for found in query_blocks(vecs, every, block_rows, False):
        own = {n: (ids, quantise(x, scale)) for n, (ids, x) in found.items()}
        block = sc.broadcast(own)  # at most 2 * block_rows vectors
        # |score| <= |q| |c|, so the first interval holds every score. Bounds are whole numbers of any size here.
        with np.errstate(over="ignore", invalid="ignore"):
            reach = {n: [min(MOST, int(min(v, 2.0**64)) + 1) for v in np.nan_to_num(np.sqrt((y**2).sum(axis=1)) * largest[n] * 1.000001, nan=0.0)] for n, (_, y) in own.items()}
        lo, last = {n: [-r for r in v] for n, v in reach.items()}, {n: list(v) for n, v in reach.items()}
        need = {n: [k] * len(v) for n, v in reach.items()}
        while any(a < z for n in own for a, z in zip(lo[n], last[n], strict=True)):
            width = {n: [-(-(z - a + 1) // BINS) for a, z in zip(lo[n], last[n], strict=True)] for n in own}
            spans = sc.broadcast({n: (np.array(lo[n], np.int64), np.array(last[n], np.int64), np.array(width[n], np.uint64)) for n in own})
            wants = spark.createDataFrame([(n, q, v) for n, a in need.items() for q, v in enumerate(a)], "dim long, q long, need long")
            upto = Window.partitionBy("dim", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            cum = _histograms(vecs, block, spans, scale, k).withColumn("upto", F.sum("n").over(upto))
            # The first bin that reaches the kth; with fewer than k scores in all, the last one.
            hit = F.max(F.struct((F.col("upto") >= F.col("need")).alias("full"), F.when(F.col("upto") >= F.col("need"), -F.col("bin")).otherwise(F.col("bin")).alias("o"), F.col("bin").alias("bin"), (F.col("upto") - F.col("n")).alias("above"))).alias("x")
            hits = {(r.dim, r.q): r.x for r in cum.join(F.broadcast(wants), ["dim", "q"]).groupBy("dim", "q").agg(hit).collect()}  # a row a query
            for n in own:
                for q in range(len(lo[n])):
                    x = hits.get((n, q))
                    if x is None:  # a query without candidates
                        last[n][q] = lo[n][q]
                        continue
                    # The next interval is the bin alone: what lies above it is counted already.
                    lo[n][q] += (BINS - 1 - x.bin) * width[n][q]
                    last[n][q] = min(last[n][q], lo[n][q] + width[n][q] - 1)
                    need[n][q] -= x.above
        lo = {n: np.array(v, np.int64) for n, v in lo.items()}
        out.append(_finish(vecs, block, sc.broadcast(lo), scale, k))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(out) > 32:
        out = [cut(reduce(DataFrame.union, out[i : i + 32]), "topk") for i in range(0, len(out), 32)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, out).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each fiftieth vector."""
    return top_k(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""
