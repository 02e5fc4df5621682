"""Words of whole texts as 64-bit hashes, column by column without a Python string for each word; a bounded cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes of text that are hashed at once; a longer word widens its piece.
PIECE = 1 << 17
_ASCII_BLANKS = (*range(9, 14), 32)


class Recent(dict):
    """A two-generation cache: bounded memory with nearly the hits of one that never forgets."""

    def __init__(self, make: Callable, most: int = 150_000) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 256:
            self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Mixes x in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, n at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for m in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def blanks(data: np.ndarray, every: bool) -> np.ndarray:
    """Which bytes of UTF-8 text are white space: the six ASCII blanks, or with `every` all that str.split() knows."""
    table = np.zeros(256, bool)
    table[list(_ASCII_BLANKS)] = True
    if every:
        table[28:32] = True
    out = table[data]
    if every and len(data) and data.max() >= 0xC2:
        padded = np.r_[data, np.zeros(2, np.uint8)]
        at = np.flatnonzero(data >= 0xC2)
        a, b, c = data[at], padded[at + 1], padded[at + 2]
        two = at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        three |= (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        out[two] = out[two + 1] = True
        for i in range(3):
            out[at[three] + i] = True
    return out


def bounds(data: np.ndarray, offsets: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word in bytes; a text's end ends a word."""
    inside = ~blanks(data, every)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_hashes(column: pa.Array, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the words of all texts one after another, and how many each text has.

    Words are separated by the six ASCII blanks and compared with A-Z as a-z; with `every`, by all white space, and
    compared without case. A word's hash is a polynomial of random values of its bytes, taken from running sums, so it
    costs a few vector operations a byte whatever the vocabulary.
    """
    if every:
        column = pc.utf8_lower(column.cast(pa.large_string()))
    data, offsets = texts(column)
    counts, found, at = np.zeros(len(offsets) - 1, np.int64), [], 0
    while at < len(data):
        to = at + PIECE
        if to < len(data):  # back to the last blank, or on to the next one
            gap = np.flatnonzero(blanks(data[at:to], every))
            while not len(gap) and to < len(data):
                to += PIECE
                gap = np.flatnonzero(blanks(data[at:to], every))
            to = at + int(gap[-1]) + 1 if len(gap) and to < len(data) else min(to, len(data))
        to = min(to, len(data))
        d = data[at:to]
        lo, hi = np.searchsorted(offsets, [at, to])
        start, end = bounds(d, offsets[lo : max(lo, hi)] - at, every)
        if len(start):
            power, inverse = _powers_to(max(len(d), PIECE))
            total = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(_FOLDED[d] * power[: len(d)], out=total[1:])
            h = (total[end] - total[start]) * inverse[start]
            h += (end - start).astype(np.uint64)
            found.append(mix(h))
            np.add.at(counts, np.searchsorted(offsets, start + at, "right") - 1, 1)
        at = to
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


def spans(text: str) -> tuple[list[int], list[int], bytes]:
    """(start, end) of each word of a text, by all white space, in bytes of its UTF-8 form, and that."""
    raw = text.encode(errors="surrogatepass")
    start, end = bounds(np.frombuffer(raw, np.uint8), np.array([0]), True)
    return start.tolist(), end.tolist(), raw


def shingles(h: np.ndarray, counts: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of each text's runs of k words; with `short`, a text of fewer words is one run of all of them."""
    n = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    if short:
        n[(counts > 0) & (counts < k)] = 1
    out = np.empty(int(n.sum()), np.uint64)
    to = np.cumsum(n) - n
    whole = n > 0 if not short else counts >= k
    at = np.repeat(first[whole] - (np.cumsum(n[whole]) - n[whole]), n[whole]) + np.arange(int(n[whole].sum()))
    parts = [(at, k, np.repeat(to[whole] - (np.cumsum(n[whole]) - n[whole]), n[whole]) + np.arange(len(at)))]
    if short:
        parts += [(first[own], m, to[own]) for m in range(1, k) if len(own := np.flatnonzero(counts == m))]
    for at, m, place in parts:
        for i in range(0, len(at), 1 << 15):  # within the processor's cache
            a = at[i : i + (1 << 15)]
            s = np.full(len(a), m, np.uint64)
            for j in range(m):  # an odd multiplier and a shift, so that the order of words counts
                s *= _U(_MULTIPLIER)
                s ^= s >> _U(32)
                s += h[a + j]
            out[place[i : i + (1 << 15)]] = mix(s)
    return out, n
