"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder (operator 6).

Two words that share a prefix have the same tokens up to a boundary that each merge of one of them across the boundary
moves back by the merge's left part; the merges that can do so one after another have rising ranks, and each one's right
part starts with the left part of the one before. The longest such chain, in symbols, is the merge list's sufficient
lookahead. So a prefix is encoded, all tokens that end before the last lookahead symbols are emitted, and only the rest
is kept: memory depends on the merge list, not on the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.common import pick, read
from tallyweave.llm.words import Recent

_models: dict[str, BpeModel] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class BpeModel:
    """A word-end BPE vocabulary file: normalisation, word split, merges, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.vocab: dict[str, int] = d["model"]["vocab"]
        self.end = d["model"]["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in reversed(list(enumerate(d["model"]["merges"])))}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: w for w, i in [*self.vocab.items(), *self.special.items()]}
        self.by_decimal = {str(i): w for i, w in self.names.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.word = regex.compile(next(x["pattern"]["Regex"] for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.letters = byte_letters()
        self.lookahead = self._lookahead()
        self.pieces = Recent(self._piece)
        self.chunks = Recent(self._chunk)

    def _lookahead(self) -> int:
        left: dict[str, str] = {}
        best: dict[str, int] = {}
        for a, b in sorted(self.ranks, key=self.ranks.get):
            left.setdefault(a + b, a)
            reach, t = 0, b
            while t is not None:  # b and the left parts within it
                reach, t = max(reach, best.get(t, 0)), left.get(t)
            best[a] = max(best.get(a, 0), len(a.removesuffix(self.end)) + reach)
        return max(best.values(), default=0) + 1

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges, lowest rank first and leftmost within a rank."""
        n, ranks = len(symbols), self.ranks
        if n < 24:
            out, none = symbols[:], 1 << 60
            near = [ranks.get(p, none) for p in zip(out, out[1:])]
            while near and (r := min(near)) < none:
                i = near.index(r)
                out[i : i + 2] = [out[i] + out[i + 1]]
                del near[i]
                if i:
                    near[i - 1] = ranks.get((out[i - 1], out[i]), none)
                if i < len(near):
                    near[i] = ranks.get((out[i], out[i + 1]), none)
            return out
        text: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if text[i] == a else -1
            if j < 0 or text[j] != b:
                continue
            text[i], text[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((text[x], text[y]))) is not None:
                    heapq.heappush(heap, (r, x, text[x], text[y]))
        return [t for t in text if t is not None]

    def stream(self, parts: Iterable[str], chunk: int = 4096) -> Iterator[str]:
        """The tokens of one word given in parts (of byte letters), each emitted once no continuation can change it."""
        held = ""
        for part in parts:
            for i in range(0, len(part), chunk):
                held += part[i : i + chunk]
                if len(held) > self.lookahead + chunk:
                    stable, at = len(held) - 1 - self.lookahead, 0
                    for t in self.merge(list(held[:-1])):
                        if at + len(t) > stable:
                            break
                        yield t
                        at += len(t)
                    held = held[at:]
        if held:
            yield from self.merge([*held[:-1], held[-1] + self.end])

    def letters_of(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode()))

    def _piece(self, piece: str) -> tuple[str, str]:
        t = list(self.stream([self.letters_of(piece)]))  # a word's end makes all of it stable
        return " ".join([str(self.vocab[x]) for x in t]), " ".join(t)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        found = [self.pieces[w] for w in self.word.findall(chunk)]
        return " ".join(f[0] for f in found), " ".join(f[1] for f in found)

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letter by letter: no final form
        return text.lower()

    def blocks(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """The text in blocks of about `size` characters, each ended by white space that no mark follows, so that blocks
        are normalised and split as the whole is; a longer run without white space widens its block."""
        at = 0
        while at < len(text):
            to = at + size
            while to < len(text) and not (text[to - 1].isspace() and not unicodedata.combining(text[to]) and not text[to].isspace()):
                to += 1
            yield text[at:to]
            at = to

    def split(self, block: str) -> list[str]:
        words = self.normal(block)
        return regex.split(r"\s+", words) if any(c in words for c in "\x1c\x1d\x1e\x1f") else words.split()

    def encode_parts(self, text: str, most: int = 4096) -> Iterator[str]:
        """encode()'s ids in parts of about `most` words or tokens; never empty ones. What is held besides the text is a
        block, a part, and of a long word the transducer's lookahead."""
        for part in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield str(self.special[part])
                continue
            for block in self.blocks(part):
                words = self.split(block)
                if words and max(map(len, words)) > most:
                    for w in words:
                        yield from self.long_word(w, most) if len(w) > most else filter(None, [self.chunks[w][0]])
                    continue
                for i in range(0, len(words), most):
                    if ids := " ".join([f[0] for f in map(self.chunks.__getitem__, words[i : i + most]) if f[0]]):
                        yield ids

    def long_word(self, word: str, most: int) -> Iterator[str]:
        """A long word's ids as its tokens become stable, in parts of `most` tokens."""
        for m in self.word.finditer(word):
            parts = (self.letters_of(m[0][i : i + most]) for i in range(0, len(m[0]), most))
            ids = (str(self.vocab[t]) for t in self.stream(parts))
            while group := " ".join(islice(ids, most)):
                yield group

    def encode(self, text: str) -> tuple[str, str]:
        """(ids in decimal, their names), each joined by one space."""
        ids, names = [], []
        for part in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                ids.append(str(self.special[part]))
                names.append(part)
            elif part:
                found = [f for f in map(self.chunks.__getitem__, self.split(part)) if f[0]]
                ids += [f[0] for f in found]
                names += [f[1] for f in found]
        return " ".join(ids), " ".join(names)


class Decoder:
    """Ids to text, one at a time. Without a decoder in the vocabulary file the library joins the tokens' own names by
    spaces (names=True); otherwise bytes go through an incremental UTF-8 state machine and a word's end is a space."""

    def __init__(self, model: BpeModel, names: bool = True) -> None:
        self.model, self.names, self.first = model, names, True
        self.bytes = {c: b for b, c in model.letters.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, i: int) -> str:
        name = self.model.names[i]
        if self.names:
            out, self.first = name if self.first else f" {name}", False
            return out
        if name in self.model.special:
            return self.finish() + name
        ended = self.model.end and name.endswith(self.model.end)
        raw = bytes(self.bytes[c] for c in name.removesuffix(self.model.end))
        return self.state.decode(raw) + (self.finish() + " " if ended else "")

    def push_all(self, ids: list[str]) -> str:
        """push() of one id after another, given in decimal."""
        if not self.names or not ids:
            return "".join(map(self.push, map(int, ids)))
        out = " ".join(map(self.model.by_decimal.__getitem__, ids))
        out, self.first = out if self.first else f" {out}", False
        return out

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def model(path: str) -> BpeModel:
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row of df.

    A null text counts as empty; ids may be null or repeat; an empty table gives an empty one; other columns are not
    looked at. Special strings in a text are their tokens, as the library does by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1):
                count, of_ids, of_text, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(m)
                for ids in m.encode_parts(t.as_py() or ""):
                    of_ids.update((f" {ids}" if count else ids).encode())
                    each = ids.split(" ")
                    count += len(each)
                    of_text.update(d.push_all(each).encode())
                n.append(count)
                x.append(of_ids.hexdigest())
                y.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    d = pick(df, id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and its ids decoded again."""
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
