"""Quality rules against plain loops, and the score against counts of features kept in dictionaries."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyweave.llm import quality

rng = random.Random(12)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def text_of(n, words="a b c d e f g h i j k"):
    return "".join(rng.choice(words.split()) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b", "\r\n"]) for _ in range(n))


TEXTS = [None, "", " \n ", "one", "a b c d e a b c d e", "x\n x\nx\nx\r\n\n \n x", "é 𝒳𝒳 ## **$%&|<> y z", "a " * 30_000, " ".join(map(str, range(30_000)))]
TEXTS += [text_of(rng.randint(1, 60), "a b c") for _ in range(60)] + [text_of(rng.randint(1, 400)) for _ in range(30)] + ["\n".join(rng.choices(["p q", "p q ", "", "r"], k=20)) for _ in range(20)]


def test_rules(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    got = {r.id: tuple(r[c] for c in BASE) for r in quality.rules(d).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def corpus(spark):
    good, bad = ["the", "house", "is", "green", "and", "we", "like", "it", "here", "now", "old", "tree"], ["BUY", "NOW", "!!!", "$$$", "click", "here", "|", "win", "###", "free", "cash", "%%%"]
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=40)) + f" n{i}") for i in range(300)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(0, 300, 2)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_score_and_threshold(spark):
    rows, labels, docs, labelled = corpus(spark)
    sample = {r.id: r for r in quality.sample_of(labelled).collect()}
    assert {i: r.trusted for i, r in sample.items()} == {i: q == 1 for i, q, _ in labels} and len({r.held for r in sample.values()}) == 2
    parts = [(i, j, w[j], w[j + 1] if j + 1 < len(w) else None) for i, t in rows for w in [re.findall(r"\w+|[^\w\s]+", t)] for j in range(len(w))]
    mask = quality.BUCKETS - 1
    one = {r.v: r.h & mask for r in spark.createDataFrame([(v,) for _, _, v, _ in parts], "v string").select("v", F.xxhash64("v").alias("h")).distinct().collect()}
    feats = {}
    for i, _, v, w in parts:
        feats.setdefault(i, []).extend([one[v]] + ([(one[v] * quality.PAIR + one[w]) & mask] if w else []))
    raw = Counter(x for f in feats.values() for x in f)
    target = Counter(x for i, f in feats.items() if i in sample and sample[i].trusted and not sample[i].held for x in f)
    n, m = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    w = [round(math.log((target[k] + 1) / n * m / (raw[k] + 1)) * quality.UNIT) for k in range(quality.BUCKETS)]
    model = quality.weights(docs.select(F.col("doc_id").alias("id"), "text"), quality.sample_of(labelled))
    assert max(abs(x - y) for x, y in zip(w, model, strict=True)) <= 1
    want = {i: int(sum(model[x] for x in f) / len(f)) for i, f in feats.items()}
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    assert {r.id: r.score for r in quality.score(ids, model).collect()} == want
    held = [[want[i] for i, r in sample.items() if r.held and r.trusted == t] for t in (True, False)]
    least = quality.threshold(ids, quality.sample_of(labelled), model)
    assert max(held[1]) < least < min(held[0])
    got = {r.doc_id: r.kept for r in quality.judge(docs, labelled).collect()}
    assert got == {i: i % 3 > 0 for i, _ in rows}


def test_edges(spark):
    _, _, docs, labelled = corpus(spark)
    more = spark.createDataFrame([(None, "the house is green and we like it here now"), (None, None), (5, ""), (5, "old tree " * 9), (7, "x" * 300_000)], "doc_id long, text string")
    clash = docs.unionByName(more).select("*", *[F.lit("x").alias(c) for c in ("id", "Text", "score", "words", "tokens", "kept", "b")])
    got = quality.judge(clash, labelled.select("*", F.lit(1).alias("id"), F.lit(9).alias("Quality"))).collect()
    assert len(got) == 305
    assert sorted((r.n_words, r.kept) for r in got if r.doc_id is None) == [(0, False), (10, True)]
    assert sorted(r.n_words for r in got if r.doc_id == 5) == [0, 18, 41]
    none = labelled.limit(0)
    assert all(r.kept or r.base_failed for r in quality.judge(docs, none).collect())
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7), (3, None)], "doc_id long, quality int")
    assert quality.sample_of(odd).count() == 0
    assert quality.judge(docs.limit(0), labelled).collect() == []
    assert quality.sample_of(labelled, 10).groupBy("trusted").count().collect()[0]["count"] == 10


def test_no_python_in_the_plan(spark):
    _, _, docs, labelled = corpus(spark)
    plan = quality.judge(docs, labelled)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_label_takes_part(spark):
    n = (1 << 16) + 500  # more of one value than the bound there was
    many = spark.range(n + 300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, 1).otherwise(0).alias("quality"))
    sample = quality.sample_of(many)
    assert {r.trusted: r["count"] for r in sample.groupBy("trusted").count().collect()} == {True: n, False: 300}
    _, _, docs, labelled = corpus(spark)
    by_id = lambda d: {r.doc_id: (r.kept, r.score) for r in d.collect()}
    assert by_id(quality.judge(docs, labelled)) == by_id(quality.judge(docs, labelled, few=0))  # sent to every task, or by a shuffle


def test_threshold_is_of_all_scores(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[: 25 + i % 15], k=rng.randint(3, 30)))) for i in range(900)], "id long, text string")
    for labels in ([(i, int(i % 3 > 0)) for i in range(900)], [(i, 1) for i in range(5)], [(i, 0) for i in range(9)]):
        sample = quality.sample_of(spark.createDataFrame(labels, "doc_id long, quality int"))
        model = quality.weights(docs, sample)
        model = [w + 9 * i for i, w in enumerate(model)]
        held = quality.score(docs.join(sample.where("held"), "id"), model)
        good, bad = held.agg(*[F.expr(f"percentile(CASE WHEN trusted = {t} THEN score END, {p})") for t, p in (("true", 0.001), ("false", 0.75))]).first()
        want = None if good is None else math.floor(good if bad is None else min(good, (good + bad) / 2))
        assert quality.threshold(docs, sample, model) == want
