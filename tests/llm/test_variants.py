"""Spelling variants against every pair of words, and the vocabulary against a plain loop."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import variants

rng = random.Random(11)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, out = {}, []
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_apart(w, v)]
        best = min(near, default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
        out.append([w, form[w], n, len(near)])
    for row in out:
        root = row[0]
        while form[root] is not None:
            root = form[root]
        row.insert(2, root)
        row.append(words[row[1]] if row[1] is not None else None)
    return sorted(map(tuple, out), key=str)


def grouped(spark, words):
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abé", "ab𝒳"])
def test_like_every_pair(spark, alphabet):
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 7))): rng.choice([1, 2, 3, 5, 8, 20, 50]) for _ in range(120)} | {"": 9}
    assert grouped(spark, words) == brute(words)


def test_long_chain_and_ties(spark):
    chain = {"a" * i: 1 << i for i in range(1, 30)}
    assert {r[2] for r in grouped(spark, chain)} == {"a" * 29}
    ties = {"cat": 2, "cut": 4, "cot": 4, "kit": 1}
    assert grouped(spark, ties) == brute(ties)


def test_a_frequent_word_with_all_its_variants(spark):
    letters = [chr(c) for c in range(97, 123)]
    words = {"house": 10_000} | {"house"[:i] + x + "house"[i + d :]: 1 for i in range(5) for x in ["", *letters] for d in (0, 1)}
    words["house"] = 10_000
    assert grouped(spark, words) == brute(words)


def vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_vocabulary(spark):
    words = ["Straße", "ÉCOLE", "école", "Ünder", "x÷y×zzz", "naïve-house", "a", "Hello", "héllo", "ŒUVRE", "snake_case", "abcdé9fghij"]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)] + [(None, None), (None, "Hello " * 5), (7, ""), (7, "Hello Hello"), (8, "x" * 20_000 + " " + "word " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("word"), F.lit(2).alias("TEXT"), F.lit(3).alias("id"))
    assert dict(map(tuple, variants.vocabulary(d, "doc_id", "text").collect())) == vocabulary(rows)


def test_empty(spark):
    assert grouped(spark, {}) == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.vocabulary(docs, "doc_id", "text")).count() == 0
    lone = spark.createDataFrame([(1, "unlike words words words stand alone alone alone")], "doc_id long, text string")
    assert sorted(r.word for r in variants.group_variants(variants.vocabulary(lone, "doc_id", "text")).collect()) == ["alone", "words"]


def test_like_its_sql(spark):
    import duckdb

    c, d = duckdb.connect(), "/root/testdata/sf0.001"
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = c.execute(variants.SQL).fetchall()
    assert sorted(map(str, map(tuple, variants.query(spark, d).collect()))) == sorted(map(str, want)) and len(want) > 100
