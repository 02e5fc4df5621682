"""Near-duplicates by fast similarity sketching (operator 8).

A document's set of 5-word shingles is sketched by rounds of hashed bin placement: in round i every shingle goes to a
random bin with a value in [i, i + 1); the second half of the rounds sends all to one bin each, so every coordinate
fills. Bands of the sketch give buckets. Equal sets are one class first. In each bucket all members meet the smallest
(a star, never all pairs), twice. What still shares a bucket with another component then meets only members that it could
reach the threshold with: those that share one of its rarest shingles (a prefix filter, which loses no link). Every link
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import keyed, only, read, slices
from tallyweave.llm.words import mix, word_hashes
from tallyweave.llm.words import shingles as runs_of
from tallyweave.operators.components import components
from tallyweave.tables import Scratch

WORDS, SIZE, BAND = 5, 128, 4
_U = np.uint64


_SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each whole text."""
    found, n = runs_of(*word_hashes(column), WORDS, True)
    ends = np.cumsum(n)
    return [np.unique(found[b - m : b]) for b, m in zip(ends.tolist(), n.tolist(), strict=True)]


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def sketch(s: np.ndarray) -> np.ndarray:
    """SIZE coordinates: round number and 50 bits of the smallest value that was placed in each bin.

    Rounds run several at once for small sets: a later round can't undercut a coordinate that an earlier one filled.
    """
    none = np.iinfo(np.uint64).max
    out, i = np.full(SIZE, none, np.uint64), 0
    while i < SIZE and (i == 0 or out.max() == none):
        n = min(SIZE - i, max(1, 8 * SIZE // len(s)) if i == 0 else max(1, 4 * SIZE // len(s)))
        h = mix(s[None, :] ^ _SEEDS[i : i + n, None])
        value = (h & _U((1 << 50) - 1)) | (np.arange(i, i + n, dtype=np.uint64) << _U(50))[:, None]
        np.minimum.at(out, (h >> _U(57)).astype(np.int64).ravel(), value.ravel())
        i += n
    for i in np.flatnonzero(out == none):  # one round each sends all shingles to that bin
        out[i] = (_U(SIZE + i) << _U(50)) | (mix(s ^ _SEEDS[SIZE + i]) & _U((1 << 50) - 1)).min()
    return out


def bands(c: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch (rows)."""
    c = c.reshape(len(c), -1, BAND)
    out = np.broadcast_to(_SEEDS[: c.shape[1]], c.shape[:2]).copy()
    for i in range(BAND):
        out = mix(out + c[:, :, i])
    return out.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(b.column(1))
        some = [i for i, s in enumerate(sets) if len(s)]
        digest = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
        keys = bands(np.stack([sketch(sets[i]) for i in some])) if some else np.empty((0, SIZE // BAND), np.int64)
        n = pa.array([len(s) for s in sets], pa.int64())
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[1:] = np.cumsum([keys.shape[1] if len(s) else 0 for s in sets])
        yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["id", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], ["id", "s"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, comp, set) to a row for each shingle."""
    for part in slices(batches, 256):
        sets = [np.frombuffer(s.as_py(), np.int64) for s in part.column(3)]
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([*(pa.array(c.to_numpy()[own]) for c in part.columns[:3]), pa.array(np.concatenate(sets))], ["id", "n", "comp", "h"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True)) if 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)) else 0
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))


def possible(own: DataFrame, sets: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b) of different components of own (id, n, comp) that could be linked.

    Shingles are ordered by how many documents hold them, those of a single component first. Linked sets share at least
    3 / 7 of the sum of their sizes, so the first one they share has that many places left in either set, itself
    included: it is among the first n / 4 + 1 of the larger set, and of both among the first n / 7 + 1 where sizes are
    equal. Shingles of a single component take places but are not shuffled for it: their number is the set's size less the
    others'. Shingles with the same holders count once. For each, only members outside its most frequent component meet
    the others.
    """
    scratch = scratch or Scratch(own.sparkSession)
    rows = scratch.cut(sets.join(own, "id").select("id", "n", "comp", "s").mapInArrow(_spread, "id long, n long, comp long, h long"), "spread")
    held = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("id")).alias("sig"))
    held = held.where("c0 < c1").select("h", "m", "sig")
    own_rows = Window.partitionBy("id")
    several = rows.join(held, "h").select("id", "n", "comp", "m", "sig", "h", F.count("*").over(own_rows).alias("k"), F.row_number().over(own_rows.orderBy("m", "sig", "h")).alias("r"))
    first = several.withColumn("r", F.col("n") - F.col("k") + F.col("r")).where("r <= n div 4 + 1")
    first = scratch.cut(first.groupBy("sig", "id", "n", "comp").agg(F.min("r").alias("r")), "prefixes")
    scratch.drop(rows)
    most = first.groupBy("sig", "comp").agg(F.count("*").alias("m")).groupBy("sig").agg(F.max(F.struct("m", "comp")).alias("o")).select("sig", F.col("o.comp").alias("most"))
    minor = first.join(most, "sig").where("comp <> most").select("sig", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("r").alias("pr"))
    near = "comp <> pc AND 4 * least(n, pn) >= 3 * greatest(n, pn) AND 7 * least(n - r + 1, pn - pr + 1) >= 3 * (n + pn)"
    return first.join(minor, "sig").where(near).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df.

    Null or blank texts have no shingles and are linked with nothing. Rows that repeat an id are documents of their own,
    linked by their own texts: one row of a component is kept. A null id has a null component and is kept. An empty table
    gives an empty one; other columns are not looked at. Sets are compared as 64-bit hashes of whole shingles. The result
    is a written table, the only one left of those that the run writes.
    """
    scratch = Scratch(df.sparkSession)
    docs, names = keyed(df, id_col, text_col, scratch)
    base = scratch.cut(docs.select("id", "text").mapInArrow(_sketches, "id long, n long, digest binary, bands array<long>"), "sketches")
    # Equal sets are one class, which its smallest id stands for.
    reps = base.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n", "bands")).alias("x"))
    flat = reps.select("x.id", "x.n", F.explode("x.bands").alias("k"))
    many = flat.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("k")
    flat = scratch.cut(flat.join(many, "k").select("k", "id", "n"), "buckets")
    comp = scratch.cut(flat.select("id").distinct().withColumn("comp", F.col("id")), "labels")
    links = met = sets = held = None
    for stars in (True, True, False):
        # Buckets that still hold several components.
        own = flat.select("k", "id", "n").join(comp.select("id", "comp"), "id")
        open_ = own.groupBy("k").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("k")
        own = scratch.cut(own.join(open_, "k").select("k", "id", "n", "comp"), "open")
        scratch.drop(flat, held)
        flat = held = own
        if stars:
            pool = own if met is None else own.join(met, ["k", "id"], "left_anti")
            rank = F.row_number().over(Window.partitionBy("k").orderBy("id"))
            pivots = scratch.cut(pool.withColumn("r", rank).where("r = 1").select("k", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc")), "pivots")
            met = pivots.select("k", F.col("p").alias("id"))
            pairs = own.join(pivots, "k").where("comp <> pc AND 4 * least(n, pn) >= 3 * greatest(n, pn)").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
            ids = None
        else:
            left = scratch.cut(own.select("id", "n", "comp").distinct(), "left")
            sets = add_sets(sets, docs, left.select("id"), scratch)
            pairs = possible(left, union(sets), scratch)
        pairs = scratch.cut(pairs, "pairs")
        if pairs.isEmpty():
            continue
        if stars:
            ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
            sets = add_sets(sets, docs, ids, scratch)
        whole = union(sets)
        x, y = whole.select(F.col("id").alias("a"), F.col("s").alias("x")), whole.select(F.col("id").alias("b"), F.col("s").alias("y"))
        new = scratch.cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "new")
        scratch.drop(pairs)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            old, comp = comp, components(comp.select("id", "comp"), links, scratch)
            scratch.drop(old)
    classes = base.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"))
    member = base.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    out = member.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("c"))
    kept = F.coalesce(F.col("id") == F.col("c"), F.lit(True))
    out = names(out.select("id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), kept.alias("kept")), "component_id")
    return scratch.end(out, "components").withColumnRenamed("id", id_col)


def add_sets(sets: list[DataFrame] | None, docs: DataFrame, ids: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (id, s) of the whole sets of all ids, those of earlier ones included."""
    sets = sets or []
    for old in sets:
        ids = ids.join(old.select("id"), "id", "left_anti")
    ids = scratch.cut(ids, "asked")
    return [*sets, scratch.cut(only(docs, ids).mapInArrow(_sets, "id long, s binary"), "sets")]


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicates' component."""
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(d, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, u.b FROM r JOIN u ON u.a = r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(x) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""
