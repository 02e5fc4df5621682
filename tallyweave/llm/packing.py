"""Best-fit packing of documents into sequences after dominance reduction (operator 3).

Lengths are whole numbers up to the capacity, so an instance is its histogram. The driver solves that: sets of up to
three lengths that provably dominate every other filling of their sequence (Martello and Toth) are fixed with their whole
multiplicity, then the rest is packed best-fit by decreasing length, group of equal sequences by group. The plan says, for
a range of ranks within a length, which sequences and offsets it gets; its size depends on the capacity alone. Ranks come
from a count by (length, salt) and a rank within each, so that a hot length is dealt over all salts.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm.bpe_stream import byte_letters
from tallyweave.llm.common import pick, read
from tallyweave.llm.words import Recent
from tallyweave.tables import Scratch

CAPACITY, SEPARATOR = 2048, 0
_encoders: dict[str, Encoder] = {}


#: White space that the fast encoder's pattern would not get through; the tokenizers library itself takes such texts.
_LONG_BLANK = re.compile(r"\s{256}")


class _Blank(Exception):
    pass


class Encoder:
    """Byte-level ids as little-endian unsigned 32-bit bytes, by chunks between single spaces, cached."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        ranks = {bytes(back[c] for c in w): i for w, i in d["model"]["vocab"].items() if w not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.chunks = Recent(self._chunk)
        self.path, self.library = path, None

    def _raw(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # A single space before a chunk starts a word of its own, unless other white space touches it.
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Blank
        return self._raw(" " + chunk)

    def encode(self, text: str) -> bytes:
        if _LONG_BLANK.search(text):
            self.library = self.library or Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(s in text for s in self.special):
            return np.array(self.core.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Blank
            return self._raw(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _Blank:
            return self._raw(text)


def pieces_of(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document's ids and the separator, cut from the end into full pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        enc, tail = _encoders[path].encode, SEPARATOR.to_bytes(4, "little")
        for b in batches:
            row, out = [], []
            for i, t in enumerate(b.column(1)):
                ids = enc(t.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    out.append((piece, x, y - x, zlib.crc32(memoryview(ids)[4 * x : 4 * y])))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c) for c in cols]], [id_col, "piece", "start", "length", "ids_crc32"])

    d = pick(df, id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, piece long, start long, length long, ids_crc32 long")


def solve(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(plan rows, number of sequences). A row (length, rank, n, sequence, each, offset): the n items of that length from
    that rank on go to sequences from there on, each of them side by side from the offset."""
    left = {k: v for k, v in counts.items() if v}
    sizes = sorted(left)
    taken = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        plan.append((length, taken[length], n, sequence, each, offset))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
            sizes.remove(length)

    def fits(room: int, without: dict[int, int]) -> int | None:
        for i in range(bisect.bisect_right(sizes, room) - 1, -1, -1):
            if left[sizes[i]] > without.get(sizes[i], 0):
                return sizes[i]
        return None

    def least(n: int, above: int, without: dict[int, int]) -> int:
        """Sum of the n smallest items over a size; beyond the capacity where there are fewer."""
        total = 0
        for s in sizes[bisect.bisect_right(sizes, above) :]:
            k = min(n, left[s] - without.get(s, 0))
            total, n = total + k * s, n - k
            if not n:
                return total
        return capacity + 1

    # Reduction: the largest length with nothing, one or two others, where every other filling is dominated.
    for big in sorted(sizes, reverse=True):
        while big in left:
            room, mine = capacity - big, {big: 1}
            one = fits(room, mine)
            if one is None:
                found = []
            elif one == room or least(2, 0, mine) > room:
                found = [one]
            else:
                two = fits(room - one, {big: 1, one: 1} if one != big else {big: 2})
                # At most two fit, the largest that fits is one of them, and no two that are larger than the other fit.
                found = [one, two] if two is not None and least(3, 0, mine) > room and least(2, two, mine) > room else None
            if found is None:
                break
            each = {s: [big, *found].count(s) for s in (big, *found)}
            m = min(left[s] // k for s, k in each.items())
            at = 0
            for s, k in sorted(each.items(), reverse=True):
                put(s, m * k, bins, k, at)
                at += s * k
            bins += m
    # Best fit: groups of sequences with as much room, [first sequence, how many], by room.
    rooms: dict[int, list[list[int]]] = {}
    order: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([first, n])

    for s in sorted(left, reverse=True):
        while s in left:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                n = -(-left[s] // each)
                add(capacity, bins, n)
                bins += n
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // s, left[s])
            m = min(n, left[s] // each)
            put(s, m * each, first, each, capacity - room)
            add(room, first + m, n - m)
            add(room - each * s, first, m)
    return plan, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces are read several times: pass a written table. Null ids and rows that
    repeat are packed as they come; no pieces give none."""
    salt = F.pmod(F.xxhash64(*pieces.columns[:2]), F.lit(salts)).alias("salt")
    own = pieces.select("*", salt)
    counts = own.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    counts = (scratch or Scratch(pieces.sparkSession)).cut(counts.withColumn("base", base), "counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many as the capacity
    plan, _ = solve(total, capacity)
    plan.sort()
    sent = pieces.sparkSession.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6).T.copy())
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*pieces.columns[:3], "ids_crc32")) - 1
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, each, offset = sent.value
        start = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            s, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(s), np.int64)
            for k in np.unique(s):
                own = s == k
                at[own] = start[k] + np.searchsorted(first[start[k] : start[k + 1]], r[own], "right") - 1
            seq, slot = np.divmod(r - first[at], each[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[at] + seq), pa.array(offset[at] + slot * s)], names)

    ranked = own.withColumn("r", rank).join(counts.select("length", "salt", "base"), ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("r")).cast("long").alias("rank"))
    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of df.

    A null text counts as empty: a piece of the separator alone. Ids may be null; rows that repeat are packed as often as
    they occur; an empty table gives an empty one; other columns are not looked at. Whole texts are encoded.
    """
    scratch = Scratch(df.sparkSession)
    pieces = scratch.cut(pieces_of(df, path, capacity, id_col, text_col), "pieces")
    return scratch.end(pack(pieces, capacity, scratch=scratch), "packed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
