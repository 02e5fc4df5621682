"""Language identification of words by a linear-chain conditional random field (operator 10).

Each word's label scores come from hashed affix, n-gram and lexicon features (of a slice's distinct words, at once), the transitions are learned with them, and
forward-backward gives each word's label probabilities; a document's language has the largest share. Training sequences
are windows of labelled documents, some spliced from two languages, so that switches within a text are learned. Long
documents are cut into blocks whose transfer matrices are chained: forward-backward over the whole text, exactly, in a
number of vectorised steps that hardly grows with its length.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyweave.llm.common import pick, read, slices
from tallyweave.llm.words import mix

UNKNOWN, BITS, BLOCK, WINDOW, TOKEN = "und", 16, 32, 24, 64
BUCKETS = 1 << BITS
#: Runs of letters; a longer one is cut into tokens of this many, so that each letter is labelled.
_WORD = regex.compile(r"[\p{L}\p{M}]{1,64}")
#: Characters that are looked at at once; a multiple of TOKEN.
PIECE = 1 << 17
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_tables: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 for letters, 1 for marks, else 0; and its lower case where that is one character."""
    if not _tables:
        kind, low = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                kind[i], x = 2, chr(i).lower()
                low[i] = ord(x) if len(x) == 1 else i
            elif c == "M":
                kind[i] = 1
        _tables.extend((kind, low))
    return _tables[0], _tables[1]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each token: runs of letters and marks, cut into tokens of TOKEN."""
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _letters()[0][points] > 0
    start, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    n = -(-(end - start) // TOKEN)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(start, n) + TOKEN * i
    return start, np.minimum(start + TOKEN, np.repeat(end, n)) - start


def _lower(points: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case characters, token, place) of the tokens, one after another."""
    token = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    return _letters()[1][points[start[token] + place]], token, place


def token_hashes(points: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token, without case."""
    if not len(n):
        return np.empty(0, np.uint64)
    c, _, place = _lower(points, start, n)
    power = np.cumprod(np.full(TOKEN, _ODD[0], np.uint64))
    return mix(np.add.reduceat(mix(c.astype(np.uint64) + _U(1)) * power[place], np.cumsum(n) - n) + n.astype(np.uint64))


def features(points: np.ndarray, start: np.ndarray, n: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, bucket) of each feature: a token's letters, pairs and triples of letters, its first and last one to three
    letters, and itself if the lexicon (sorted hashes) has it."""
    c, token, place = _lower(points, start, n)
    left = n[token] - place  # letters from here on
    one = mix(c.astype(np.uint64) + _U(7))
    two = np.append(mix(one[:-1] * _ODD[0] + one[1:]), _U(0))
    three = np.append(mix(two[:-2] * _ODD[1] + one[2:]), np.zeros(min(2, len(one)), np.uint64))
    owner, found = [], []
    for i, gram in enumerate((one, two, three)):
        for salt, at in enumerate((np.flatnonzero(left > i), np.flatnonzero((place == 0) & (left > i)), np.flatnonzero(left == i + 1))):
            owner.append(token[at])
            found.append(mix(gram[at] ^ _U(3 * salt)))
    if len(lexicon):
        at = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes)
        owner.append(at)
        found.append(mix(hashes[at] + _U(11)))
    return np.concatenate(owner), (np.concatenate(found) >> _U(64 - BITS)).astype(np.int64)


def train(rows: list[tuple[str, list[str]]], epochs: int = 6, rate: float = 0.05, seed: int = 5) -> dict:
    """rows: (label, words of a window). The model: labels, lexicon, feature weights and transitions."""
    labels = sorted({r[0] for r in rows})
    k, rng = len(labels), np.random.default_rng(seed)
    known = {w for y in labels for w, _ in Counter(w.lower() for r in rows if r[0] == y for w in r[1]).most_common(200)}

    def cut(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        points = points_of(" ".join(words))
        start, n = tokens(points)
        return points, start, n, token_hashes(points, start, n)

    lexicon = np.unique(cut(sorted(known))[3])
    at = {y: i for i, y in enumerate(labels)}
    rows = [(y, ws) for y, ws in rows if ws]
    points, start, n, hashes = cut([w for _, ws in rows for w in ws])
    owner, bucket = features(points, start, n, hashes, lexicon)
    order = np.argsort(owner, kind="stable")
    bucket, upto = bucket[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(n)))]
    ends = np.cumsum([len(ws) for _, ws in rows])
    seqs = [(np.arange(e - len(ws), e), np.full(len(ws), at[y])) for e, (y, ws) in zip(ends, rows, strict=True)]
    for _ in range(len(seqs) // 2):
        (a, x), (b, y) = (seqs[i] for i in rng.integers(len(seqs), size=2))
        seqs.append((np.r_[a[: len(a) // 2], b[len(b) // 2 :]], np.r_[x[: len(x) // 2], y[len(y) // 2 :]]))
    seqs = [s for s in seqs if len(s[0])]
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, gt = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for i in range(0, len(order), 64):
            batch = [seqs[j] for j in order[i : i + 64]]
            word = np.concatenate([s for s, _ in batch])
            m = upto[word + 1] - upto[word]
            own = np.repeat(np.arange(len(word)), m)
            ids = bucket[np.repeat(upto[word] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            score = np.stack([np.bincount(own, w[ids, j], len(word)) for j in range(k)], axis=1)
            size = np.array([len(s) for s, _ in batch])
            gold = np.eye(k)[np.concatenate([ys for _, ys in batch])]
            post, pairs = forward_backward(score, size, t, want_pairs=True)
            inner = np.setdiff1d(np.arange(len(word) - 1), np.cumsum(size) - 1)
            dt = pairs - np.einsum("ij,il->jl", gold[inner], gold[inner + 1])
            dw = np.stack([np.bincount(ids, (post - gold)[own, j], BUCKETS) for j in range(k)], axis=1)
            for x, d, g in ((w, dw, gw), (t, dt, gt)):
                d = d / len(batch) + 1e-6 * x
                g += d * d
                x -= rate * 4 * d / np.sqrt(g)
    return {"labels": labels, "lexicon": lexicon, "w": w.astype(np.float32), "t": t}


def forward_backward(score: np.ndarray, size: np.ndarray, t: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each row's label probabilities; score holds sequences of the given sizes (over 0) one after another.

    Sequences are cut into blocks, whose vectors stand side by side, so that a step is one product of small by wide. Of
    a sequence of several blocks the products of transfer matrices carry what lies before and after a block.
    """
    k, total = t.shape[0], len(score)
    e, tr = np.exp(score - score.max(axis=1, keepdims=True)), np.exp(t - t.max())
    blocks = -(-size // BLOCK)
    nb = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    seq_of = np.repeat(np.arange(len(size)), blocks)
    inside = np.arange(nb) - first_block[seq_of]
    start = (np.cumsum(size) - size)[seq_of] + inside * BLOCK
    n = np.minimum(BLOCK, size[seq_of] - inside * BLOCK)
    x = np.ascontiguousarray(e[np.minimum(start[:, None] + np.arange(BLOCK), total - 1)].transpose(1, 2, 0))
    over = [np.flatnonzero(n <= s) for s in range(BLOCK)]  # blocks that have ended before a step
    fore, back = np.ones((k, nb)), np.ones((k, nb))
    long = np.flatnonzero(blocks[seq_of] > 1)
    if len(long):
        place = np.zeros(nb, np.int64)
        place[long] = np.arange(len(long))
        m = np.zeros((k, k, len(long)))  # to, from, block
        m[np.arange(k), np.arange(k)] = 1.0
        for s in range(BLOCK):
            new = (tr.T @ m.reshape(k, -1)).reshape(m.shape) * x[s][:, None, long]
            stay = np.flatnonzero(n[long] <= s)
            new[:, :, stay] = m[:, :, stay]
            m = new / new.max(axis=(0, 1)) if s % 8 == 7 else new
        m /= m.max(axis=(0, 1))
        by_step = [np.flatnonzero(blocks > i) for i in range(int(blocks.max()))]
        for i in range(1, len(by_step)):
            b = first_block[by_step[i]] + i
            v = np.einsum("tfb,fb->tb", m[:, :, place[b - 1]], fore[:, b - 1])
            fore[:, b] = v / v.max(axis=0)
        for i in range(len(by_step) - 2, -1, -1):
            b = first_block[by_step[i + 1]] + i
            v = np.einsum("tfb,tb->fb", m[:, :, place[b + 1]], back[:, b + 1])
            back[:, b] = v / v.max(axis=0)
    alpha, beta = np.empty((BLOCK, k, nb)), np.empty((BLOCK, k, nb))
    v, opening = fore, inside == 0  # the first word of a text has no transition before it
    for s in range(BLOCK):
        v = (np.where(opening, 1.0, tr.T @ v) if s == 0 else tr.T @ v) * x[s]
        if s % 8 == 7:
            v = v / v.max(axis=0)
        alpha[s] = v
    v = back
    for s in range(BLOCK - 1, -1, -1):
        beta[s] = v
        new = tr @ (v * x[s])
        new[:, over[s]] = v[:, over[s]]
        v = new / new.max(axis=0) if s % 8 == 0 else new
    real = np.arange(BLOCK)[None, :] < n[:, None]
    a, b = alpha.transpose(2, 0, 1)[real], beta.transpose(2, 0, 1)[real]
    post = a * b
    post /= post.sum(axis=1, keepdims=True)
    if not want_pairs:
        return post, None
    inner = np.setdiff1d(np.arange(total - 1), np.cumsum(size) - 1)
    p = a[inner][:, :, None] * tr * (e[inner + 1] * b[inner + 1])[:, None, :]
    return post, (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(text, piece) of all texts, in order: a piece ends at its text's end, or beyond PIECE characters where no token is
    cut that tokens() would not cut."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            inside = _letters()[0][points_of(t[at : at + PIECE])] > 0
            gap = np.flatnonzero(~inside)
            to = at + (int(gap[-1]) + 1 if len(gap) else PIECE)
            yield i, t[at:to]
            at = to
        if at < len(t):
            yield i, t[at:]


def emissions(parts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label scores of all tokens, tokens of each part, which parts have a letter)."""
    points = points_of("\0".join(parts))
    start, n = tokens(points)
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(parts))
    has = np.bincount(np.searchsorted(ends, np.flatnonzero(_letters()[0][points] == 2), "right"), minlength=len(parts)) > 0
    hashes = token_hashes(points, start, n)
    own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    k = len(model["labels"])
    if not len(own):
        return np.empty((0, k)), counts, has
    token, bucket = features(points, start[first], n[first], own, model["lexicon"])
    w = model["w"]
    return np.stack([np.bincount(token, w[bucket, j], len(own)) for j in range(k)], axis=1)[which], counts, has


def learn(df: DataFrame, per_label: int = 300, windows: int = 3, labels: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model of a bounded sample: about per_label different documents of each label among those that aren't held out, at
    most twice as many, and of each up to `windows` windows of WINDOW words at hashed places.

    Documents are chosen by a hash of id and text, copies count once, and each label is bounded by itself; so null and
    repeated ids and large groups of copies lose no label. None if there is none; an error if there are more than `labels`
    languages, as a model and its sample grow with them.
    """
    d = pick(df, id_col, text_col, lang_col).toDF("id", "text", "lang").where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    d = d.withColumn("h", F.xxhash64("id", "text"))
    counts = {r.lang: r.n for r in d.groupBy("lang", "h").agg(F.lit(1).alias("n")).groupBy("lang").agg(F.count("*").alias("n")).limit(labels + 1).collect()}
    if not counts:
        return None
    if len(counts) > labels:
        raise ValueError(f"there are more than {labels} languages")
    share = F.element_at(F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(1.0, per_label / n))]), F.col("lang"))

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, ws = [], []
            for y, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = _WORD.findall(t)
                for j in range(min(windows, -(-len(words) // WINDOW))):
                    at = zlib.crc32(f"{h}:{j}".encode()) % max(1, len(words) - WINDOW + 1)
                    ys.append(y)
                    ws.append(words[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.string()), pa.array(ws, pa.list_(pa.string()))], ["y", "w"])

    some = d.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("lang", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # over about per_label rows of a label
    some = some.withColumn("place", place).where(F.col("place") <= 2 * per_label).select("lang", "h", "text")
    sample = some.mapInArrow(cut_windows, "y string, w array<string>")
    rows = sorted((r.y, r.w) for r in sample.collect())  # at most 2 windows per_label rows for each of `labels`
    return train(rows) if rows else None


def predict(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of df, from the text alone, and the row's column `keep` if one is named.

    A text that is null or has no letter is `und` with score 0, as is all without a model. Ids may be null (not held out)
    or repeat; an empty table gives an empty one; other columns are not looked at.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x labels and the lexicon

    def judged(texts: list[str], m: dict) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        of, parts, scores, counts, has, size = [], [], [], [], [], 0

        def settle() -> None:
            if parts:
                e, n, h = emissions(parts, m)
                scores.append(e)
                counts.append(n)
                has.append(h)
                parts.clear()

        for i, part in pieces(texts):
            if size + len(part) > PIECE:
                settle()
                size = 0
            of.append(i)
            parts.append(part)
            size += len(part)
        settle()
        if not of:
            return lang, score
        each = np.bincount(of, np.concatenate(counts), len(texts)).astype(np.int64)
        some = np.flatnonzero((np.bincount(of, np.concatenate(has), len(texts)) > 0) & (each > 0))
        e = np.concatenate(scores)
        mine = np.repeat(np.isin(np.arange(len(texts)), some), each)
        if len(some):
            post, _ = forward_backward(e[mine], each[some], m["t"])
            mean = np.add.reduceat(post, np.cumsum(each[some]) - each[some]) / each[some][:, None]
            lang[some] = np.array(m["labels"], object)[mean.argmax(axis=1)]
            score[some] = np.minimum(1.0, mean.max(axis=1))
        return lang, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, 128):
            lang, score = judged([t or "" for t in b.column(2).to_pylist()], m) if m else (np.full(len(b), UNKNOWN, object), np.zeros(len(b)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *b.columns[3:]], [id_col, "held_out", "lang_pred", "score", *kept])

    kept = [keep] if keep else []
    d = pick(df, id_col, text_col, *kept)
    d = d.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col, *kept)
    out = StructType([d.schema[0], d.schema[1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), *d.schema.fields[3:]])
    return d.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
