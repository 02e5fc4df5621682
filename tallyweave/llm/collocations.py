"""Phrase collocation mining (operator 13): bucket-counted n-grams (PCY, DHP), Apriori pruning, exact counts.

Pass k counts exactly the k-grams that may reach the least count, and on the same read counts (k + 1)-grams by hashed
bucket. A k-gram may reach it only if its own bucket did in the pass before, and both (k - 1)-grams in it did exactly;
both are told by bitmaps, broadcast in a size that is bounded whatever the corpus holds. A bitmap only prunes: what two
n-grams share in it is counted once more than needed and dropped by its exact count. Within a task n-grams are told apart
by the numbers of their words, not by hashes; across tasks by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import pick, read
from tallyweave.llm.words import mix, texts
from tallyweave.tables import Scratch

LONGEST, LEAST, SCALE, INSIDE, FIRST, NONE = 4, 30, 2_000_000, 80, 2000, "und"
#: Bits of the bitmaps: a bit for each so many bytes of text, within bounds (2^28 bits are 32 MB).
BYTES_A_BIT, FEWEST_BITS, MOST_BITS = 16, 16, 28
#: Bytes of text that a task holds as words at once; a longer word widens its block.
BLOCK = 1 << 20
_U = np.uint64
_BREAKS, _BLANKS = np.zeros(256, bool), np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANKS[list(b" \t")] = True
_APART = _BREAKS | _BLANKS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ORDER = _U(0x9E3779B97F4A7C15)
#: Words of a bitmap in a row of a page.
PAGE = 1 << 15


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of an n-gram from those of its first words and its last one; the order counts."""
    return mix(a * _ORDER + b)


class _Block:
    """Words of a piece of the texts: their numbers, hashes, languages, and whether each goes on its predecessor's piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, fresh: int) -> None:
        inside = ~_APART[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        n = len(self.start)
        sizes = np.r_[0, np.cumsum(self.end - self.start)]
        body = np.ascontiguousarray(_LOWER[data[inside]])
        column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
        coded = column.dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        own = _string_hashes(self.words)
        text = np.searchsorted(offsets, self.start, "right") - 1
        self.lang = langs[text]
        self.hash = own[self.code]
        self.lang_hash = lang_hash[self.lang]
        breaks = np.r_[0, np.cumsum(_BREAKS[data])]
        self.joined = np.zeros(n, bool)  # to the word before it
        if n:
            self.joined[1:] = (breaks[self.start[1:]] == breaks[self.end[:-1]]) & (text[1:] == text[:-1])
        self.fresh = np.arange(n) >= np.searchsorted(self.start, fresh)


def _string_hashes(words: pa.Array) -> np.ndarray:
    """Of distinct words: polynomials over their bytes, one position of all words at a time; of words over 64 bytes xxhash64."""
    raw, at = texts(words)
    out, n = np.zeros(len(at) - 1, np.uint64), np.diff(at)
    order = np.argsort(-n, kind="stable")
    sizes = -n[order]
    for i in range(min(64, int(n.max(initial=0)))):
        rows = order[: np.searchsorted(sizes, -i)]  # longer words come first
        out[rows] = (out[rows] ^ (raw[at[rows] + i].astype(np.uint64) + _U(1))) * _ORDER
    for k in np.flatnonzero(n > 64).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k + 1]].tobytes())
    return mix(out)


def _blocks(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[tuple[_Block, pa.Array]]:
    """Blocks of about BLOCK bytes with the languages of their batch; n-grams that end in a block's fresh words are its own.

    A block that goes on within a text starts `context` words before its own.
    """
    for b in batches:
        lang = b.column(0).dictionary_encode()
        names = lang.dictionary
        langs = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = _string_hashes(names)
        data, offsets = texts(b.column(1))
        at = back = 0
        while at < len(data):
            to = at + BLOCK
            while to < len(data) and not _APART[data[to]]:
                more = np.flatnonzero(_APART[data[to : to + BLOCK]])
                to = to + int(more[0]) if len(more) else to + BLOCK
            to = min(to, len(data))
            lo, hi = np.searchsorted(offsets, back, "right") - 1, np.searchsorted(offsets, to)
            own = np.clip(offsets[lo : hi + 1] - back, 0, to - back)
            block = _Block(data[back:to], own, langs[lo:hi], hashes, at - back)
            yield block, names
            keep = block.start[-context:] if context else block.start[:0]
            at, back = to, back + int(keep[0]) if len(keep) else to


def _grams(block: _Block, k: int, bits: int, known: list, buckets: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends of the k-grams that may be frequent, and the hash of the gram of 1, 2, ... words that ends at each word.

    known: bitmaps of the frequent grams of 1 to k - 1 words; buckets: that of the buckets of k-grams.
    """
    h, at, hashes = block.lang_hash ^ block.hash, np.ones(len(block.hash), bool), []
    h = mix(h.copy())
    for j in range(1, k + 1):
        if j > 1:
            grown = np.zeros_like(h)
            before = np.zeros_like(at)
            before[1:] = at[:-1]
            at = at & before & block.joined  # both shorter grams may be frequent
            i = np.flatnonzero(at)
            grown[i] = _hash(h[i - 1], block.hash[i])
            h = grown
        hashes.append(h)
        told = known[j - 1] if j < k else buckets
        if told is not None:
            i = np.flatnonzero(at)
            place = h[i] >> _U(64 - bits)
            at[i] = told[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1 == 1
    return at, hashes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number) of each distinct key, and which of them each key is."""
    _, first, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, n, which


def _count(block: _Block, names: pa.Array, k: int, at: np.ndarray) -> pa.RecordBatch:
    """Exact counts of the k-grams that end at the given words, told apart by the numbers of language and words."""
    end = np.flatnonzero(at)
    which, first, n = block.lang[end], None, None
    for j in range(k - 1, -1, -1):
        first, n, which = _distinct(which * len(block.words) + block.code[end - j])
    if not len(end):
        return _rows(0, pa.nulls(0, pa.string()), pa.nulls(0, pa.string()), np.empty(0), np.empty(0))
    rep = end[first]
    words = [block.words.take(pa.array(block.code[rep - j])).cast(pa.string()) for j in range(k - 1, -1, -1)]
    phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")
    return _rows(0, names.take(pa.array(block.lang[rep])).cast(pa.string()), phrase, np.zeros(len(rep)), n)


_SCHEMA = pa.schema([("kind", pa.int8()), ("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


def _rows(kind: int, lang: pa.Array, phrase: pa.Array, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """kind 0: a phrase's count; 1: a bucket's; 2: the words of a language."""
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), lang, phrase, pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], schema=_SCHEMA)


def _pass(k: int, longest: int, bits: int, bitmaps) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, buckets = bitmaps.value
        for block, names in _blocks(batches, longest - 1):
            at, hashes = _grams(block, k, bits, known, buckets)
            yield _count(block, names, k, at & block.fresh)
            if k == 1:
                lang, n = np.unique(block.lang[block.fresh], return_counts=True)
                yield _rows(2, names.take(pa.array(lang)).cast(pa.string()), pa.nulls(len(lang), pa.string()), np.zeros(len(lang)), n)
            if k < longest:
                end = np.flatnonzero(at[1:] & at[:-1] & block.joined[1:] & block.fresh[1:]) + 1
                place, n = np.unique(_hash(hashes[-1][end - 1], block.hash[end]) >> _U(64 - bits), return_counts=True)
                yield _rows(1, pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), place, n)

    return run


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits of a table (bucket), gathered in pages of PAGE bits."""
    page = F.expr("bitmap_construct_agg(bitmap_bit_position(bucket + 1))").alias("bitmap")
    out = np.zeros(max(PAGE, 1 << bits) // 8, np.uint8)
    pages = places.groupBy(F.expr("bitmap_bucket_number(bucket + 1)").alias("page")).agg(page)
    for r in pages.toLocalIterator():  # at most 2^bits / PAGE rows of 4 KB
        out[(r.page - 1) * PAGE // 8 : r.page * PAGE // 8] = np.frombuffer(r.bitmap, np.uint8)
    return out


def _places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The bit of each frequent phrase."""
    for b in batches:
        lang, phrase = b.column(0), b.column(1).cast(pa.string())
        words = pc.list_flatten(pc.split_pattern(phrase, " ")).dictionary_encode()
        own = _string_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
        n = pc.list_value_length(pc.split_pattern(phrase, " ")).to_numpy(zero_copy_only=False)
        langs = lang.dictionary_encode()
        first = np.cumsum(n) - n
        h = mix(_string_hashes(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)] ^ own[first])
        for j in range(1, int(n.max(initial=1))):
            h = _hash(h, own[first + j])
        yield pa.RecordBatch.from_arrays([pa.array((h >> _U(64 - bits)).astype(np.int64))], ["bucket"])


def frequent(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of 1 to `longest` words with n >= least, and (lang, total) of all words.

    docs has (lang, text), neither null. `bits` sets the bitmaps' size, by default after the bytes of text; it changes
    what is counted in vain, never the result.
    """
    spark = docs.sparkSession
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, (size // BYTES_A_BIT).bit_length()))
    known, buckets, found, total = [], None, [], None
    for k in range(1, longest + 1):
        sent = spark.sparkContext.broadcast((known, buckets))
        rows = docs.mapInArrow(_pass(k, longest, bits, sent), "kind byte, lang string, phrase string, bucket long, n long")
        counts = rows.groupBy("kind", "lang", "phrase", "bucket").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("kind") == 2))
        counts = scratch.cut(counts, f"grams{k}")
        sent.destroy()
        found.append(counts.where("kind = 0").select("lang", "phrase", F.lit(k).alias("k"), "n"))
        if k == 1:
            total = counts.where("kind = 2").select("lang", F.col("n").alias("total"))
        if k < longest:
            places = counts.where("kind = 0").select("lang", "phrase").mapInArrow(lambda it: _places(it, bits), "bucket long")
            known = [*known, _bitmap(places, bits)]
            buckets = _bitmap(counts.where("kind = 1").select("bucket"), bits)
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return scratch.cut(out, "frequent"), total


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(grams: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of several words: the cut of the lowest score, ties to the first.

    Counts are exact to 19 digits; the products have up to 38.
    """
    many = grams.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = many.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(F.lit(1), F.col("cut")).alias("head"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    part = lambda c, n: grams.select(F.col("lang"), F.col("phrase").alias(c), F.col("n").alias(n))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"CAST(CAST({scale} AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    best = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def absorbed(grams: DataFrame, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, longer) of the phrases within longer ones: the largest count of a longer one."""
    long = grams.where("k > 2").select("lang", "k", "n", F.split("phrase", " ").alias("words"))

    def parts_of(m: int) -> Column:
        return F.when(F.col("k") > m, F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part(i, F.lit(m))))

    parts = [parts_of(m) for m in range(2, longest)]
    if not parts:
        return long.select("lang", F.lit("").alias("phrase"), F.col("n").alias("longer")).limit(0)
    own = long.select("lang", "n", F.explode(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))).alias("phrase"))
    return own.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def first_of_each(df: DataFrame, n: int, order: list[Column], scratch: Scratch) -> DataFrame:
    """The first n rows of each lang with their rank, in three rounds: within 4,096 parts of a language, within 64 of what
    is left, then of the at most 64 n rows that are left."""
    d = df.withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.lit(4096)))
    for shift in (0, 6, None):
        keys = ["lang"] if shift is None else ["lang", F.shiftright("part", shift)]
        d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return d.drop("part")


def mine(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, first: int = FIRST, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    Phrases are runs of 2 to `longest` words that occur `least` times. Null texts count as empty and null languages as
    `und`; rows count as often as they are there, whatever their ids. Ties of score and count go by the UTF-8 bytes of the
    phrase. An empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession)
    docs = pick(df, lang_col, text_col).toDF("lang", "text")
    docs = docs.select(F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    grams, total = frequent(docs, scratch, longest, least, bits)
    d = scored(grams).join(absorbed(grams, longest), ["lang", "phrase"], "left")
    # In wide decimals, as the counts times a hundred may pass 64 bits.
    kept = d.where("longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * " + str(INSIDE))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = first_of_each(kept.select("lang", "phrase", "a", "l", "r", "score"), first, order, scratch)
    out = best.join(F.broadcast(total) if total.count() < PAGE else total, "lang")
    return scratch.end(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '{NONE}') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM docs),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS n
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND n >= {LEAST}),
cuts AS (
  SELECT f.*, c, l.n AS l, r.n AS r, (({SCALE}::HUGEINT * a) // (l.n::HUGEINT + r.n))::BIGINT AS score
  FROM found f, range(1, {LONGEST}) t(c), grams l, grams r
  WHERE c < f.k AND l.lang = f.lang AND l.phrase = array_to_string(w[1:c], ' ') AND r.lang = f.lang AND r.phrase = array_to_string(w[c + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT s.* FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.lang = s.lang AND f.k > s.k AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * f.a >= {INSIDE}::HUGEINT * s.a))
SELECT * FROM (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, t.n, score FROM kept k JOIN total t ON t.lang = k.lang)
WHERE rank <= {FIRST}
"""
