"""What the operators share: column picking, shared-folder tables and vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import Scratch, cut  # noqa: F401



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by position so that extra columns, even ones that differ by case only, can't clash.

    An exact match wins over one that ignores case.
    """
    own = df.columns
    at = []
    for name in names:
        hits = [i for i, c in enumerate(own) if c == name] or [i for i, c in enumerate(own) if c.lower() == name.lower()]
        if not hits:
            raise ValueError(f"there is no column {name} among {own}")
        at.append(hits[0])
    plain = df.toDF(*[f"c{i}" for i in range(len(own))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(at, names, strict=True)])


def keyed(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(id long, text) with ids that tell rows apart, and what puts the table's own ids back into named columns of ids.

    Where ids repeat, rows are numbered in the order of their ids and written with their numbers, so that the smallest
    number of a set of rows is one of its smallest id. Null ids stay null.
    """
    docs = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        return docs, lambda found, *_: found
    row = F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())
    rows = scratch.cut(docs.orderBy("id", F.xxhash64("text")).select(row.alias("row"), "id", "text"), "rows")

    def names(found: DataFrame, *columns: str) -> DataFrame:
        out = found
        for c in ("id", *columns):
            own = rows.where("row IS NOT NULL").select(F.col("row").alias(f"__{c}"), F.col("id").alias("__name"))
            out = out.join(own, F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.col("__name")).drop(f"__{c}", "__name")
        return out.select(found.columns)

    return rows.select(F.col("row").alias("id"), "text"), names


def rows_with_key(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(key, text, row) for each row of df, and what unpacks rows to columns c0, c1, ... before others that are named.

    The key is the id, or where ids repeat a number that rises with it, written with the rows; null ids have a null key.
    Names of columns can't clash, as columns go by place.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    key, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    rows = df.toDF(*names).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.struct(*names).alias("row"))
    if not rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").isEmpty():
        number = F.when(F.col("key").isNotNull(), F.monotonically_increasing_id())
        rows = cut(rows.orderBy("key", F.xxhash64("text")).withColumn("key", number), "rows")
    return rows, lambda d, *more: d.select("row.*", *more)


def only(docs: DataFrame, ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows of docs whose id is in ids, a written table: up to `most` ids (8 MB) go to every task, more meet the texts
    by a shuffle."""
    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices: what is held for each row of a batch while it is worked on is held for a slice only."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def by_dim(batch: pa.RecordBatch, drop_zero: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each vector length in a batch of (id long, vector array<double>).

    Rows with a null id, a null or empty vector, or null or non-finite components are left out; with drop_zero, zero
    vectors as well.
    """
    ids, vec = batch.column(0), batch.column(1)
    offsets = vec.offsets.to_numpy()
    values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.diff(offsets)
    valid = vec.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[valid & (lengths > 0)]):
        at = np.flatnonzero(valid & (lengths == n))
        rows = values[offsets[at][:, None] + np.arange(n)]
        fine = np.isfinite(rows).all(axis=1)
        if drop_zero:
            fine &= (rows != 0).any(axis=1)
        if fine.any():
            yield keys[at[fine]].astype(np.int64), rows[fine]


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    d = pick(df, id_col, vec_col)
    return d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def query_blocks(vecs: DataFrame, every: int, block_rows: int, drop_zero: bool) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The stated queries (id divisible by every) in blocks of about block_rows, each as {length: (ids, matrix)}.

    A block is a hash bucket of the ids, fetched on its own: what reaches the driver is bounded by block_rows (a bucket
    that exceeds twice that raises), while the number of blocks grows with the input. Of rows that share a query's id,
    one (the smallest vector) asks.
    """
    asked = vecs.where(F.col("id").isNotNull() & (F.pmod("id", F.lit(every)) == 0) & F.col("vec").isNotNull())
    blocks = max(1, -(-asked.count() // block_rows))
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = own.groupBy("id").agg(F.min("vec").alias("vec")).limit(2 * block_rows + 1).toArrow()
        if rows.num_rows > 2 * block_rows:
            raise RuntimeError("a block of queries is larger than its bound")
        out: dict[int, list] = {}
        for batch in rows.combine_chunks().to_batches():
            for ids, x in by_dim(batch, drop_zero):
                out.setdefault(x.shape[1], []).append((ids, x))
        packed = {}
        for n, parts in out.items():
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids)
            packed[n] = (ids[order], x[order])
        if packed:
            yield packed


def own_rows(asked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where candidates are the query itself: (rows of ids, places in the sorted asked)."""
    at = np.minimum(np.searchsorted(asked, ids), len(asked) - 1)
    rows = np.flatnonzero(asked[at] == ids)
    return rows, at[rows]


def best_of(q: np.ndarray, order_key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each q, by order_key and then ids, both ascending."""
    order = np.lexsort((ids, order_key, q))
    s = q[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return order[rank < k]
