"""Fuzzy repeated passages by collinear chaining (operator 4).

Winnowed k-mers of words are the seeds. Every occurrence of a seed meets the seed's first one (smallest document, then
place) and the last one in the document before its own among those that hold the seed, so a seed that occurs n times
makes fewer than 2n matches. A document's matches with each partner are chained in order of both texts with gap costs:
where both places rise the chain is plain, else the best predecessor comes from Fenwick trees. Chains are then aligned
word by word between and beyond their seeds, with edits allowed. Passages of enough words are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import keyed, only, read, rows_with_key, slices
from tallyweave.llm.words import mix, shingles, spans, word_hashes
from tallyweave.tables import Scratch

K, WINNOW, GAP, LEAST = 5, 4, 40, 30
#: What a seed is worth in a chain; a gap costs the words of both sides.
MATCH = 2 * (GAP + K)
#: How far beyond its seeds a chain is aligned: as far as a gap between seeds may go.
EDGE = GAP
#: Words beyond which a chain is aligned on its own, and places of a run of three words beyond which it anchors nothing.
LONG, OFTEN = 2048, 8
_U = np.uint64
_MATCH = ["h", "id", "at", "partner", "there", "kind"]
MET, ASK_FIRST, ASK_BEFORE, BEGINS, ENDS = range(5)


def winnow(s: np.ndarray, n: np.ndarray, w: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in s) of the smallest k-mer of each window of w k-mers of each text; n k-mers a text, one after
    another. A text of fewer k-mers is one window."""
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.cumsum(n) - n
    low, at, width = s, np.arange(len(s)), 1
    while width < min(w, len(s)):  # the first smallest of each window, from those of two overlapping halves
        step = min(width, w - width, len(low) - 1)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    text = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero((np.repeat(first + n, n)[: len(at)] - np.arange(len(at)) >= w) & (width >= w))
    at = at[whole]
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    few = np.flatnonzero((n > 0) & (n < w))
    best = first[few]
    for i in range(1, w):
        other = first[few] + np.minimum(i, n[few] - 1)
        best = np.where(s[other] < s[best], other, best)
    at = np.r_[at, best].astype(np.int64)
    return text[at], at


class Fenwick:
    """The largest (value, index) over a prefix."""

    def __init__(self, n: int) -> None:
        self.t = [(-(1 << 60), -1)] * (n + 1)

    def put(self, i: int, v: tuple[int, int]) -> None:
        i += 1
        while i < len(self.t):
            if self.t[i] < v:
                self.t[i] = v
            i += i & -i

    def best(self, i: int) -> tuple[int, int]:
        out = self.t[0]
        while i > 0:
            out = max(out, self.t[i])
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of places in x and y, both strictly rising within a chain. A match is worth MATCH; a gap costs its words in
    both texts, so the best predecessor is the best by score plus place.

    Predecessors lie at most GAP words before a match in either text: there is a pair of Fenwick trees, one from below and
    one from above, for each block of places, so that the blocks a match can reach are asked and no chain that ended far
    away hides a near one.
    """
    wide, half = GAP + K, (GAP + K) // 2
    xs, ys = x.tolist(), y.tolist()
    order = np.lexsort((y, x)).tolist()
    below: dict[tuple[int, int], Fenwick] = {}
    above: dict[tuple[int, int], Fenwick] = {}
    score, back = {}, {}
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and xs[order[j]] == xs[order[i]]:
            j += 1
        for m in order[i:j]:
            a, b = xs[m], ys[m]
            yb, yo = divmod(b, wide)
            value, prev = 0, -1
            for xb in (a // half, a // half - 1, a // half - 2):
                for tree, to in ((below.get((xb, yb)), yo), (above.get((xb, yb - 1)), wide - yo)):
                    if tree:
                        v, p = tree.best(to)
                        if p >= 0 and a - xs[p] <= wide and v - a - b > value:
                            value, prev = v - a - b, p
            score[m], back[m] = MATCH + value, prev
        for m in order[i:j]:  # equal x can't follow one another
            a, b = xs[m], ys[m]
            yb, yo = divmod(b, wide)
            at, v = (a // half, yb), (score[m] + a + b + 2 * K, m)
            if at not in below:
                below[at], above[at] = Fenwick(wide), Fenwick(wide)
            below[at].put(yo, v)
            above[at].put(wide - 1 - yo, v)
        i = j
    used, out = set(), []
    for m in sorted(score, key=score.get, reverse=True):
        chain = []
        while m >= 0 and m not in used:
            used.add(m)
            chain.append(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        s, n = shingles(*word_hashes(part.column(1), True), K, False)
        text, at = winnow(s, n)
        ids = part.column(0).to_numpy()[text]
        yield pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), pa.array(ids), pa.array((at - (np.cumsum(n) - n)[text]).astype(np.int32))], ["h", "id", "at"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (h, id, at) that are sorted by h, sorted by all three; those of the last h wait for the next batch."""
    held: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
        at = int(np.searchsorted(x[:, 0], x[-1, 0]))
        if at == 0 and held and held[-1][-1, 0] == x[0, 0]:
            held.append(x)
            continue
        whole = np.concatenate([*held, x[:at]])
        if len(whole):
            yield settle(whole)
        held = [x[at:]]
    if held:
        yield settle(np.concatenate(held))


def _match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (h, id, at) of a range of (h, id), sorted by h, to matches, kind MET. What came before the range is not
    known here: occurrences of its first seed ask for that seed's first one (ASK_FIRST), those of its first document for
    the one before as well (ASK_BEFORE), and every range tells where its first and last seeds begin (BEGINS) and its last
    occurrence (ENDS)."""
    h0 = g0 = None  # the range's first seed and document
    carry = np.zeros((3, 3), np.int64)  # the seed's first occurrence, the last one in the document before, the last one
    before = False  # whether the second of them is there

    def rows(x: np.ndarray, kind: int, to: np.ndarray | None = None) -> pa.RecordBatch:
        y = x if to is None else to
        h = x[:, 0] if kind != MET else np.zeros(len(x), np.int64)  # a match needs no seed any more
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h, x[:, 1], x[:, 2], y[:, 1], y[:, 2], np.full(len(x), kind, np.int64))], _MATCH)

    for own in _in_order(batches):
        x = np.concatenate([carry, own])
        i = np.arange(len(x))
        new_h = np.r_[False, False, False, x[3:, 0] != x[2:-1, 0]]
        if h0 is None:
            h0, g0, new_h[3] = x[3, 0], x[3, 1], True
            yield rows(x[3:4], BEGINS)
        new_g = new_h | np.r_[False, False, False, x[3:, 1] != x[2:-1, 1]]
        run, group = np.maximum.accumulate(np.where(new_h, i, 0)), np.maximum.accumulate(np.where(new_g, i, 0))
        prev = np.where(group > 0, group - 1, 1)
        has = np.where(group > 0, ~new_h[group], before)
        opening = x[:, 0] == h0
        to_first = ~opening & (x[run, 1] != x[:, 1])
        to_prev = has & (opening | (x[prev, 1:] != x[run, 1:]).any(axis=1))
        to_first[:3] = to_prev[:3] = opening[:3] = False
        at = np.r_[np.flatnonzero(to_first), np.flatnonzero(to_prev)]
        if len(at):
            yield rows(x[at], MET, x[np.r_[run[to_first], prev[to_prev]]])
        if opening.any():
            yield rows(x[opening], ASK_FIRST)
            if len(first := x[opening & (x[:, 1] == g0)]):
                yield rows(first, ASK_BEFORE)
        carry, before = np.stack([x[run[-1]], x[prev[-1]], x[-1]]), bool(has[-1])
    if h0 is not None:
        yield rows(carry[2:], ENDS)
        yield rows(carry[:1], BEGINS)


def matches(found: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, partner, at, there) of occurrences (h, id, at), and the table they are read from.

    A seed that very many documents hold is dealt out by document; what one range of documents must know of those before
    it are the ends of the ranges, a few rows each.
    """
    # By h alone, a single number, Spark sorts by radix; a seed's own rows are put in order as they are read.
    held = found.repartitionByRange("h", "id").sortWithinPartitions("h").mapInArrow(_match_rows, ", ".join(f"{c} long" for c in _MATCH))
    held = (scratch or Scratch(found.sparkSession)).cut(held, "matches")
    begins = held.where(F.col("kind") == BEGINS).groupBy("h").agg(F.min(F.struct("id", "at")).alias("o")).select("h", "o.id", "o.at").orderBy("h").toArrow()  # two rows a range at most
    h, to, there = (np.asarray(c.to_numpy(), np.int64) for c in begins.columns)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, i, at, partner, where, kind = (c.to_numpy() for c in b.columns)
            k, asks = np.minimum(np.searchsorted(h, seed), len(h) - 1), kind == ASK_FIRST
            partner, where = np.where(asks, to[k], partner), np.where(asks, there[k], where)
            fine = pa.array(~asks | (partner < i))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, partner, at, where)], ["id", "partner", "at", "there"]).filter(fine)

    met = held.where(F.col("kind").isin(MET, ASK_FIRST)).mapInArrow(answer, "id long, partner long, at long, there long")
    # A document's occurrences of a seed are all in one range, so the end before it is of an earlier document.
    ends = F.when(F.col("kind") == ENDS, F.struct("id", "at"))
    asked = held.where(F.col("kind").isin(ASK_BEFORE, ENDS)).withColumn("e", F.max(ends).over(Window.partitionBy("h").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)))
    prev = asked.where((F.col("kind") == ASK_BEFORE) & F.col("e").isNotNull()).select("id", F.col("e.id").alias("partner"), "at", F.col("e.at").alias("there"))
    return met.unionByName(prev), held


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (id, partner, at, there), sorted, to chains; a pair may go on in the next batch. A match may come twice: where
    a range begins within a seed, that seed's first holder may be the one before as well."""
    held: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        x, y = rows[:, 2], rows[:, 3]
        dx, dy = np.diff(x, prepend=x[:1]), np.diff(y, prepend=y[:1])
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] | (dx > GAP + K)  # no chain goes on here
        start = np.flatnonzero(new)
        plain = np.repeat(~np.logical_or.reduceat(~new & ((dx <= 0) | (dy <= 0)), start), np.diff(np.r_[start, len(rows)]))
        first = np.flatnonzero(plain & (new | (dy > GAP + K)))
        last = np.r_[first[1:], len(rows)][: len(first)] - 1
        ends = np.flatnonzero(plain & np.r_[~plain[1:], True])  # a chain ends before a tangled stretch, too
        if len(first):
            last = np.minimum(last, ends[np.searchsorted(ends, first)])
        out = [np.stack([rows[first, 0], rows[first, 1], x[first], x[last] + K, y[first], y[last] + K], axis=1)]
        tangled = start[~plain[start]]
        to = np.r_[start, len(rows)][np.searchsorted(start, tangled) + 1]
        found = [(rows[a, 0], rows[a, 1], x[a + c[0]], x[a + c[-1]] + K, y[a + c[0]], y[a + c[-1]] + K) for a, b in zip(tangled.tolist(), to.tolist(), strict=True) for c in chains(x[a:b], y[a:b])]
        out.append(np.array(found, np.int64).reshape(-1, 6))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], ["id", "partner", "a0", "a1", "b0", "b1"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
        other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        at = int(other[-1]) + 1 if len(other) else 0
        if at == 0 and held and (held[-1][-1, :2] == rows[0, :2]).all():
            held.append(rows)
            continue
        whole = np.concatenate([*held, rows[:at]])
        if len(whole):
            yield settle(whole)
        held = [rows[at:]]
    if held:
        yield settle(np.concatenate(held))


def _codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 16-bit codes: alignment allows edits, and these are most of what is shuffled. Two different words look
    alike once in 65,536 times, three in a row hardly ever."""
    for b in slices(batches):
        h, n = word_hashes(b.column(1), True)
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(2 * n, out=ends[1:])
        raw = pa.py_buffer(h.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), raw]).cast(pa.binary())], ["id", "w"])


_MIXED = mix(np.arange(1 << 16, dtype=np.uint64) + _U(1))


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """A hash of each three words in a row."""
    m = _MIXED[codes]
    return m[..., :-2] * _U(3) + m[..., 1:-1] * _U(5) + m[..., 2:]


def _accepted(x: tuple[int, int, int, int, int]) -> bool:
    return x[4] > 0 and 4 * x[4] >= 3 * max(x[1] - x[0], x[3] - x[2])


def align(p: np.ndarray, q: np.ndarray, first: int = 0, last: tuple[int, int] | None = None, runs: tuple[list[int], list[int]] | None = None) -> tuple[int, int, int, int, int]:
    """(start, end) in p and q of the aligned stretch and how many words match; all 0 if no stretch has 75% of its words
    matched.

    The chain begins at word `first` of both and ends before the words `last` of p and q. Place by place comes first,
    which settles copies and replaced words. It is final only if it covers the whole chain in both texts and no run of
    three words is left beyond it that both hold; otherwise (words were put in or left out) the best chain of common runs
    decides. A stretch begins and ends with three matching words. `runs` are the hashes of each three words, if known.
    """
    n = min(len(p), len(q))
    if n < 3:
        return 0, 0, 0, 0, 0
    ends = last or (len(p), len(q))
    eq = p[:n] == q[:n]
    threes = np.flatnonzero(eq[:-2] & eq[1:-1] & eq[2:])
    tp, tq = runs or (_trigrams(p).tolist(), _trigrams(q).tolist())
    best = (0, 0, 0, 0, 0)
    if len(threes):
        a, z = int(threes[0]), int(threes[-1]) + 3
        best = (a, z, a, z, int(eq[a:z].sum()))
        if best[4] >= 0.9 * (z - a) and a <= first and z >= max(ends) and set(tp[:a]).isdisjoint(tq[:a]) and set(tp[z - 2 :]).isdisjoint(tq[z - 2 :]):
            return best
    found = _stretch(_blocks(p.tolist(), q.tolist(), tp, tq))
    return max((x for x in (best, found) if _accepted(x)), key=lambda x: x[4], default=(0, 0, 0, 0, 0))


def _blocks(p: list[int], q: list[int], tp: list[int], tq: list[int]) -> list[tuple[int, int, int]]:
    """The chain of common runs (start in p, in q, words), rising in both, with the most words.

    Runs grow from three words that both hold; those that q holds at more than OFTEN places anchor none, but runs grow
    over them.
    """
    where: dict[int, list[int]] = {}
    for j, t in enumerate(tq):
        where.setdefault(t, []).append(j)
    done: dict[int, int] = {}
    found = []
    for i, t in enumerate(tp):
        js = where.get(t, ())
        for j in js if len(js) <= OFTEN else ():
            if done.get(j - i, 0) >= i + 3:
                continue
            a, b, e, f = i, j, i + 3, j + 3
            while e < len(p) and f < len(q) and p[e] == q[f]:
                e, f = e + 1, f + 1
            while a and b and p[a - 1] == q[b - 1]:
                a, b = a - 1, b - 1
            done[j - i] = e
            if e - a >= 3:  # else two hashes are equal by chance
                found.append((a, b, e - a))
    found.sort()
    # As runs of threes they don't overlap: each ends before the next one begins, in both texts.
    tree, score, back = Fenwick(len(q)), [0] * len(found), [-1] * len(found)
    by_end = sorted(range(len(found)), key=lambda i: found[i][0] + found[i][2])
    at = 0
    for i, (a, b, n) in enumerate(found):
        while at < len(by_end) and found[by_end[at]][0] + found[by_end[at]][2] - 2 <= a:
            k = by_end[at]
            if k < i:
                tree.put(found[k][1] + found[k][2] - 3, (score[k], k))
            at += 1
        value, prev = tree.best(b)
        score[i], back[i] = (n + value, prev) if prev >= 0 and value > 0 else (n, -1)
    out, i = [], max(range(len(found)), key=score.__getitem__, default=-1)
    while i >= 0:
        out.append(found[i])
        i = back[i]
    return out[::-1]


def _stretch(blocks: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """Of the stretches from one block of runs to another, the accepted one with the most matching words: a run that
    both texts hold far from the passage by chance doesn't cost the passage."""
    if not blocks:
        return 0, 0, 0, 0, 0
    # Runs of three words may overlap where words repeat or were put in: each word counts once.
    total, upto = [], 0
    for i, (a, b, n) in enumerate(blocks):
        if i:
            c, d, m = blocks[i - 1]
            n = min(n, a + n - c - m, b + n - d - m)
        upto += n
        total.append(upto)
    best = (0, 0, 0, 0, 0)
    for i, (a, b, n) in enumerate(blocks):
        before = total[i] - n
        if upto - before <= best[4]:
            break
        for j in range(len(blocks) - 1, i - 1, -1):  # a block alone is always accepted
            c, d, m = blocks[j]
            same = total[j] - before
            if same <= best[4]:
                break
            if 4 * same >= 3 * max(c + m - a, d + m - b):
                best = (a, c + m, b, d + m, same)
                break
    return best


class Texts:
    """A column of code strings as one array, with where each begins and how many words it has."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
        self.flat, self.start, self.n = flat, start, n

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Texts:
        n = np.array([len(p) for p in parts], np.int64)
        return cls(np.concatenate(parts).astype(np.uint16), np.cumsum(n) - n, n)

    @classmethod
    def column(cls, column: pa.Array) -> Texts:
        _, offsets, data = column.cast(pa.large_binary()).buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
        flat = np.frombuffer(data, np.uint16) if data is not None and data.size else np.zeros(1, np.uint16)
        return cls(flat, at[:-1], np.diff(at))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.n[i]]

    def matrix(self, rows: np.ndarray, wide: int) -> np.ndarray:
        """The first `wide` codes of each row; beyond a text's end anything."""
        return self.flat[np.minimum(self.start[rows][:, None] + np.arange(wide), len(self.flat) - 1)]


def _covered(held: np.ndarray) -> np.ndarray:
    """How many words lie in runs of three that are held, by row."""
    words = np.zeros((len(held), held.shape[1] + 2), bool)
    for i in range(3):
        words[:, i : i + held.shape[1]] |= held
    return words.sum(axis=1)


def _settled(ps: Texts, qs: Texts, rows: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For many short chains at once: (results as align() gives them, which of them still need it, runs of p, runs of q).

    A chain is settled if place by place covers it and nothing common is left beyond, or if no alignment can have `least`
    matching words, as fewer words lie in runs of three that both texts hold. Most chance matches are told by a table of
    the runs' short hashes, which may hold too many but never too few; sorted runs tell the others.
    """
    np_, nq = ps.n[rows], qs.n[rows]
    wide = int(max(np_.max(), nq.max(), 3))
    col, row = np.arange(wide), np.arange(len(rows))
    p, q = ps.matrix(rows, wide), qs.matrix(rows, wide)
    eq = (p == q) & (col < np.minimum(np_, nq)[:, None])
    runs = eq[:, :-2] & eq[:, 1:-1] & eq[:, 2:]
    has = runs.any(axis=1)
    a, z = runs.argmax(axis=1), wide - runs[:, ::-1].argmax(axis=1)
    cum = np.zeros((len(rows), wide + 1), np.int32)
    np.cumsum(eq, axis=1, out=cum[:, 1:])
    same = np.where(has, cum[row, z] - cum[row, a], 0)
    likely = 4 * same >= 3 * (z - a)  # place by place alone is a passage's worth
    tp, tq = _trigrams(p), _trigrams(q)
    valid_p, valid_q = (col[:-2] < (n - 2)[:, None] for n in (np_, nq))
    table = np.zeros((len(rows), 1 << 12), bool)
    table[np.broadcast_to(row[:, None], tq.shape)[valid_q], (tq >> _U(52)).astype(np.int64)[valid_q]] = True
    maybe = table[row[:, None], (tp >> _U(52)).astype(np.int64)] & valid_p
    out, todo = np.zeros((len(rows), 5), np.int64), np.zeros(len(rows), bool)
    on = np.flatnonzero((_covered(maybe) >= least) | likely & (same >= least))
    if not len(on):
        return out, todo, tp, tq
    # Which runs of three words both texts hold: neighbours of both sides in sorted order.
    at = col[:-2].astype(np.uint64)
    keys = np.concatenate([(t[on] >> _U(14) << _U(14)) | _U(side << 13) | at for side, t in ((0, tp), (1, tq))], axis=1)
    keys[~np.concatenate([valid_p[on], valid_q[on]], axis=1)] = np.iinfo(np.uint64).max
    keys.sort(axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = (keys[:, 1:] ^ keys[:, :-1]) >> _U(14) != 0
    side = (keys & _U(1 << 13) != 0).ravel()
    begin = np.flatnonzero(new.ravel())
    both = ~side[begin] & side[np.r_[begin[1:], len(side)] - 1]  # within a run p comes before q
    where = np.flatnonzero(np.repeat(both, np.diff(np.r_[begin, len(side)])) & ~side)
    held = np.zeros((len(on), wide - 2), bool)
    held[where // keys.shape[1], (keys.ravel()[where] & _U((1 << 13) - 1)).astype(np.int64)] = True
    a, z, same, has, likely = a[on], z[on], same[on], has[on], likely[on]
    inside = (col[:-2] >= a[:, None]) & (col[:-2] < (z - 2)[:, None])
    final = has & (same >= 0.9 * (z - a)) & (a <= first[on]) & (z >= last[on].max(axis=1)) & ~(held & ~inside).any(axis=1)
    lost = ~final & (_covered(held) < least) & ~(likely & (same >= least))
    out[on] = np.where((final & likely)[:, None], np.stack([a, z, a, z, same], axis=1), 0)
    todo[on] = ~(final | lost)
    return out, todo, tp, tq


def _align_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        i, j, a0, b0, first, last_p, last_q = (c.to_numpy() for c in b.columns[:7])
        p, q = Texts.column(b.column(7)), Texts.column(b.column(8))
        size = np.maximum(p.n, q.n)
        out = np.zeros((len(b), 5), np.int64)
        order = np.argsort(size, kind="stable")
        slow = order[size[order] > LONG].tolist()
        order = order[size[order] <= LONG]
        last, at = np.stack([last_p, last_q], axis=1), 0
        while at < len(order):  # about 2^16 words a piece
            n = 512
            while n > 1 and n * size[order[min(at + n, len(order)) - 1]] > 1 << 16:
                n //= 2
            own = order[at : at + n]
            out[own], todo, tp, tq = _settled(p, q, own, first[own], last[own], least)
            for r in np.flatnonzero(todo).tolist():
                k = own[r]
                runs = tp[r, : max(0, p.n[k] - 2)].tolist(), tq[r, : max(0, q.n[k] - 2)].tolist()
                out[k] = align(p[k], q[k], int(first[k]), (int(last_p[k]), int(last_q[k])), runs)
            at += n
        for k in slow:
            out[k] = align(p[k], q[k], int(first[k]), (int(last_p[k]), int(last_q[k])))
        fine = np.flatnonzero(out[:, 4] >= least)
        x = out[fine]
        cols = [i[fine], j[fine], a0[fine] + x[:, 0], a0[fine] + x[:, 1], b0[fine] + x[:, 2], b0[fine] + x[:, 3], x[:, 4]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["id", "partner", "a0", "a1", "b0", "b1", "same"])


def _found(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(id, a0, a1, partner, b0, b1, same) of docs (id, text) whose ids tell rows apart."""
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL")
    found = scratch.cut(docs.mapInArrow(_seed_rows, "h long, id long, at int"), "seeds")
    match, held = matches(found, scratch)
    scratch.drop(found)
    chained = match.repartition("id", "partner").sortWithinPartitions("id", "partner", "at", "there").mapInArrow(_chain_rows, "id long, partner long, a0 long, a1 long, b0 long, b1 long")
    chained = scratch.cut(chained, "chains")
    scratch.drop(held)
    need = scratch.cut(chained.select("id").union(chained.select("partner")).distinct(), "need")
    codes = scratch.cut(only(docs, need).mapInArrow(_codes_of, "id long, w binary"), "codes")
    # Beyond its seeds a passage may go on for a gap on either side.
    c = chained.withColumn("first", F.least(F.lit(EDGE), "a0", "b0")).withColumn("x0", F.col("a0") - F.col("first")).withColumn("y0", F.col("b0") - F.col("first"))
    c = c.select("id", "partner", "x0", "y0", "first", (F.col("a1") - F.col("x0")).alias("last_p"), (F.col("b1") - F.col("y0")).alias("last_q"))
    part = lambda w, at, n: F.expr(f"substring({w}, cast({at} * 2 + 1 as int), cast(({n} + {EDGE}) * 2 as int))")
    c = c.join(codes.select(F.col("id").alias("partner"), F.col("w").alias("wq")), "partner").withColumn("q", part("wq", "y0", "last_q")).drop("wq")
    c = c.join(codes, "id").select("id", "partner", "x0", "y0", "first", "last_p", "last_q", part("w", "x0", "last_p").alias("p"), "q")
    out = c.mapInArrow(partial(_align_rows, least=least), "id long, partner long, a0 long, a1 long, b0 long, b1 long, same long")
    return out.distinct().select("id", "a0", "a1", "partner", "b0", "b1", "same")


def passages(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, partner, partner_start, partner_end, n_same): passages of at least `least` words of a
    document that an earlier one (by id) holds too, up to edits.

    Words are separated by white space and compared without case. Null ids and null or short texts have no passages; rows
    that repeat an id are documents of their own, in an order of their own; an empty table gives an empty one; other
    columns are not looked at. Repeats within one document are left alone. Of a passage's ends up to 7 words may be left out
    that only a document between the first and the last holder has. The result is a written table, the only one
    left of those that the run writes.
    """
    scratch = Scratch(df.sparkSession)
    docs, names = keyed(df, id_col, text_col, scratch)
    found = scratch.end(names(_found(docs, least, scratch), "partner"), "passages")
    return found.toDF(id_col, "start_word", "end_word", "partner", "partner_start", "partner_end", "n_same")


def remove(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", few: int = 1 << 19) -> DataFrame:
    """df with every later copy of a passage taken out of its text; rows without passages stay as they are, and so do rows
    with a null id or text. Rows that repeat an id are documents of their own. Columns may have any names. Up to `few`
    passages (8 MB) are sent to every task, more meet the rows by a shuffle."""
    scratch = Scratch(df.sparkSession)
    rows, pick = rows_with_key(df, id_col, text_col)
    found = scratch.cut(_found(rows.select(F.col("key").alias("id"), "text"), least, scratch).select("id", "a0", "a1").distinct(), "spans")
    own = found.groupBy(F.col("id").alias("key")).agg(F.collect_list(F.struct("a0", "a1")).alias("spans"))
    own = scratch.end(own, "removed")
    small = own.agg(F.sum(F.size("spans"))).first()[0] or 0
    flat = pick(rows.join(F.broadcast(own) if small <= few else own, "key", "left"), "spans")
    at, names = df.columns.index(text_col), [f"c{i}" for i in range(len(df.columns))]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, s in enumerate(b.column(len(names)).to_pylist()):
                if s and texts[i]:
                    x, y, raw = spans(texts[i])
                    keep, end = [], 0
                    for r in sorted(s, key=lambda r: (r["a0"], r["a1"])):
                        if x[r["a0"]] > end:
                            keep.append(raw[end : x[r["a0"]]])
                        end = max(end, y[r["a1"] - 1])
                    texts[i] = b"".join([*keep, raw[end:]]).decode(errors="surrogatepass").strip()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])], names)

    plain = df.toDF(*names)
    return flat.mapInArrow(strip, plain.schema).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier document holds."""
    return passages(read(spark, sf_dir, "documents"))
