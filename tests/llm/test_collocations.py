"""Collocations against a plain count of all n-grams, whatever the bitmaps' size and the blocks' bounds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import collocations

rng = random.Random(13)


def brute(rows, least, first):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * inside[lang, w] < 80 * a:
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1))


def mined(spark, rows, least, first, bits=None):
    d = spark.createDataFrame(rows, "lang string, text string").select("*", *[F.lit("x").alias(c) for c in ("Lang", "TEXT", "n", "phrase", "k", "bucket")])
    got = collocations.mine(d, least=least, first=first, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def text(n, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(n))


WORDS = ["New", "york", "éa", "Éa", "the", "of", "und", "𝒳", "x" * 70, "x" * 71, "a-b", "#"]
ROWS = [(rng.choice(["en", "fr", None]), text(rng.randint(0, 60), WORDS) + " new york city hall") for _ in range(120)] + [("en", None), (None, ""), ("xx", "one two"), ("en", " .,; \t\n"), ("", "new york " * 40)]


@pytest.mark.parametrize("bits", [3, 8, 20, None])
def test_like_a_plain_count(spark, bits):
    assert mined(spark, ROWS, 4, 30, bits) == brute(ROWS, 4, 30)


def test_blocks_within_texts(spark, monkeypatch):
    rows = [("en", text(4000, WORDS)), ("fr", "y" * 3000 + " " + "z " * 3000), ("en", "a b c d e f " * 500)]
    d = spark.createDataFrame(rows, "lang string, text string")
    batch = d.toArrow().combine_chunks().to_batches()[0]
    for size in (7, 64, 1000, 1 << 22):
        monkeypatch.setattr(collocations, "BLOCK", size)
        n = Counter()
        for block, names in collocations._blocks(iter([batch]), 3):
            at, _ = collocations._grams(block, 3, 16, [None, None], None)
            r = collocations._count(block, names, 3, at & block.fresh).to_pydict()
            for lang, phrase, c in zip(r["lang"], r["phrase"], r["n"], strict=True):
                n[lang, phrase] += c
        want = Counter()
        for lang, t in rows:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in t)):
                w = re.findall("[^ \t]+", piece)
                want.update((lang, " ".join(w[i : i + 3])) for i in range(len(w) - 2))
        assert n == want


def test_pruning_keeps_little(spark):
    """With bitmaps that are large enough only what is frequent is counted exactly."""
    rows = [("en", f"w{i} w{i + 1} w{i + 2} good morning") for i in range(500)]
    d = spark.createDataFrame(rows, "lang string, text string").toArrow().combine_chunks().to_batches()
    bits = 20
    sent = type("Sent", (), {"value": ([], None)})
    first = [r for b in collocations._pass(1, 4, bits, sent)(iter(d)) for r in b.to_pylist()]
    import numpy as np

    def bitmap(places):
        out = np.zeros((1 << bits) // 8, np.uint8)
        for p in places:
            out[p >> 3] |= 1 << (p & 7)
        return out

    n = Counter()
    for r in first:
        n[r["kind"], r["phrase"], r["bucket"]] += r["n"]
    import pyarrow as pa

    frequent = [p for (kind, p, _), c in n.items() if kind == 0 and c >= 30]
    assert sorted(frequent) == ["good", "morning"]
    places = [r for b in collocations._places(iter([pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "phrase": frequent})]), bits) for r in b.column(0).to_pylist()]
    sent.value = ([bitmap(places)], bitmap([b for (kind, _, b), c in n.items() if kind == 1 and c >= 30]))
    second = [(r["kind"], r["phrase"], r["n"]) for b in collocations._pass(2, 4, bits, sent)(iter(d)) for r in b.to_pylist()]
    assert second == [(0, "good morning", 500)]


def test_products_over_64_bits(spark):
    n = 9 * 10**18
    grams = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, n - 7), ("en", "a b", 2, n - 9)], "lang string, phrase string, k int, n long")
    assert collocations.scored(grams).first().score == 2_000_000 * (n - 9) // (n + n - 7)


def test_empty(spark):
    assert mined(spark, [], 30, 10) == []
    assert mined(spark, [(None, None), ("en", "a b")], 30, 10) == []


def test_like_its_sql(spark):
    import duckdb

    c, d = duckdb.connect(), "/root/testdata/sf0.001"
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = c.execute(collocations.SQL).fetchall()
    assert sorted(map(tuple, collocations.query(spark, d).collect())) == sorted(want) and want
