"""Each operator on empty tables, nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm import ann, bpe_stream, crf_langid, licences, minhash, packing, pii, registry, substring, topk, url_filter

rng = random.Random(31)
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def draw(n):
    return " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))


LONG = " ".join([draw(2000)] * 20)
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, draw(80)), (5, LONG), (6, "\n" * 50_000), (7, "x" * 50_000), (8, "é" * 3000), (None, draw(20)), (9, draw(10)), (9, draw(12))]
#: Columns whose names differ from the operator's own by case, or are those of its result or of its inner columns.
CLASH = {"DOC_ID": "a", "Text": "b", "id": "c", "n_shingles": 1, "key": 2, "row": 3, "__spans": 4, "__path": 5, "c0": 6, "lang_pred": "d", "spans": 7}


def clash(df):
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model():
    en, fr = ["the", "and", "house", "with", "this", "that"], ["le", "les", "maison", "avec", "cette", "dans"]
    return crf_langid.train([(y, rng.choices(ws, k=24)) for _ in range(40) for y, ws in (("en", en), ("fr", fr))])


def operators(model):
    return {
        "packing": lambda d: packing.pack_documents(d, BYTE),
        "substring": substring.passages,
        "remove": substring.remove,
        "pii": pii.find_spans,
        "bpe": lambda d: bpe_stream.encode_documents(d, WORD),
        "minhash": minhash.near_duplicates,
        "licences": lambda d: licences.scan(d, "doc_id", F.lit("a/b"), "text"),
        "language": lambda d: crf_langid.predict(d, model),
    }


@pytest.mark.parametrize("name", ["packing", "substring", "remove", "pii", "bpe", "minhash", "licences", "language"])
def test_text_operators(spark, model, name):
    op, plain = operators(model)[name], docs(spark)
    whole = sorted(map(str, (tuple(r) for r in op(plain).collect())))
    other = op(clash(plain))
    if name == "remove":
        other = other.toDF(*(f"c{i}" for i in range(len(other.columns)))).select("c0", "c1", "c2")
    if name != "packing":  # which of equal pieces comes first may differ
        assert sorted(map(str, (tuple(r) for r in other.collect()))) == whole
    else:
        assert other.count() == len(whole)
    assert op(docs(spark, [])).count() == 0
    if name in ("pii", "bpe", "language", "minhash", "licences", "remove"):
        assert len(whole) == len(TEXTS)  # a row for each row


def test_repeated_ids_are_documents_of_their_own(spark):
    a, b = draw(60), draw(60)
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (3, draw(60)), (4, draw(30))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 4, True)]
    passage = draw(60)
    rows = [(5, passage), (7, draw(50) + " " + passage), (7, "short"), (7, passage + " " + draw(40))]
    left = sorted(r.text for r in substring.remove(docs(spark, rows)).collect())
    assert passage in left and "short" in left and sum(passage in t for t in left) == 1


def test_substring_chains_and_ties():
    far = np.r_[np.arange(0, 397, 6), np.arange(600, 715, 6)]
    assert sorted(map(len, substring.chains(far, far.copy()))) == [20, 67]  # a long chain far away hides no near one
    assert substring.chains(np.array([5, 5, 5]), np.array([1, 2, 3])) and not substring.chains(np.array([], int), np.array([], int))
    rows = np.array(sorted({(1, 0, rng.randrange(300), rng.randrange(300)) for _ in range(60)} | {(2, 0, 10 * i, 10 * i) for i in range(9)}))
    import pyarrow as pa

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], ["id", "partner", "at", "there"]) for i in range(0, len(rows), size)]
        return sorted(tuple(r.values()) for b in substring._chain_rows(iter(batches)) for r in b.to_pylist())

    assert run(7) == run(1000) and (2, 0, 0, 85, 0, 85) in run(7)


def test_batch_alignment_agrees_with_single():
    ps, qs, first, last = [], [], [], []
    for _ in range(300):
        v, n = rng.choice([5, 50, 3000]), rng.randrange(5, 120)
        p = [rng.randrange(v) for _ in range(n)]
        q = p[:]
        for _ in range(rng.choice([0, 1, 3, 20])):
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice([[], [rng.randrange(v)], [q[k], rng.randrange(v)]]) if len(q) > 3 else [q[k]]
        f = rng.randrange(min(len(p), len(q)) // 2 + 1)
        ps.append(np.array(p, np.uint16)), qs.append(np.array(q, np.uint16)), first.append(f), last.append((rng.randrange(f, len(p) + 1), rng.randrange(f, len(q) + 1)))
    out, todo, _, _ = substring._settled(substring.Texts.of(ps), substring.Texts.of(qs), np.arange(len(ps)), np.array(first), np.array(last), 30)
    for k in np.flatnonzero(~todo):
        one = substring.align(ps[k], qs[k], first[k], last[k])
        assert tuple(out[k]) == one or max(one[4], out[k][4]) < 30


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, VEC_ID string")


def test_vector_operators(spark):
    x = np.random.default_rng(3).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:320] = x[0]
    rows = [(i, v.tolist(), "r", "v") for i, v in enumerate(x)] + [(500, None, "r", "v"), (550, [None] * 64, "r", "v"), (600, [float("inf")] * 64, "r", "v"), (650, [0.0] * 64, "r", "v"), (700, [], "r", "v"), (None, x[1].tolist(), "r", "v")]
    q = np.floor(256 * x).astype(np.int64)
    q = np.vstack([q, np.zeros((1, 64), np.int64)])
    ids = [*range(400), 650]
    want = []
    for a, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(q[a] @ q[b]), j) for b, j in enumerate(ids) if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == want  # unit vectors; every kth is kept
    near = ann.nearest(vectors(spark, rows)).collect()
    assert {r.query_id for r in near} == {0, 100, 200, 300} and [r.vec_id for r in sorted(near, key=lambda r: r.rank) if r.query_id == 0] == list(range(300, 310))
    twice = rows[:60] + rows[:3]
    assert len([r for r in topk.top_k(vectors(spark, twice)).collect() if r.query_id == 0]) == 5
    for op in (topk.top_k, ann.nearest):
        assert op(vectors(spark, [])).count() == 0


def test_topk_of_large_components(spark):
    rows = [(i, [3e5 * (i + 1), -2.0 * i, 1.0], "r", "v") for i in range(60)] + [(100, [1e200, 1.0, 1.0], "r", "v"), (150, [-1e12, 5.0, 0.0], "r", "v")]
    v = {i: [int(np.floor(256 * c)) if c < 1e100 else int(256 * c) for c in x] for i, x, *_ in rows}
    most = 2**63 - 1
    want = []
    for i in v:
        if i % 50 == 0:
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v[i], v[j])))), j) for j in v if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == want


def test_urls(spark):
    rows = [(1, "http://a.com/en/" + "x" * 100_000, "h"), (1, "http://a.com/en/1", "h"), (1, "http://a.com/en/1", "h"), (None, "http://b.net/de/8", "h"), (2, "", "h")]
    d = spark.createDataFrame(rows, "page_id long, url string, HOST string").select("*", F.lit(1).alias("Url"), F.lit("x").alias("rule"))
    got = url_filter.judge_urls(d, url_filter.CONTRACT_RULES).collect()
    assert len(got) == 5 and sum(r.verdict == "block" for r in got) == 3 and {r.rule for r in got} == {"com/en/", "net/de/", None}
    assert url_filter.judge_urls(d.where("false"), url_filter.CONTRACT_RULES).count() == 0
    assert url_filter.judge_urls(d, []).where("verdict = 'allow'").count() == 5


def test_url_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("block,com/en/\nallow,example.com/en/7\n")
    d = spark.createDataFrame([(1, "http://example.com/en/71"), (2, "http://a.com/en/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(d, url_filter.read_rules(spark, f"{tmp_path}/rules.csv")).collect()}
    assert got == {1: "allow", 2: "block"}
    with pytest.raises(ValueError):
        list(url_filter.read_rules(spark, f"{tmp_path}/rules.csv", most=1))


def test_packing_of_long_blanks():
    t, e = Tokenizer.from_file(BYTE), packing.Encoder(BYTE)
    for x in ["\n" * 100_000, " " * 300 + "x", "a" * 20_000, "a \n " * 3000]:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_blocks_and_long_words(spark):
    m, t = bpe_stream.BpeModel(WORD), Tokenizer.from_file(WORD)
    for x in ["ab" * 6000 + " x", "x " * 70_000 + "é", "a " * 33_000 + "́b", "日本" * 5000, "a\x1cb " * 20_000, "".join(rng.choices("abc é \n", k=70_000))]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert " ".join(m.encode_parts(x)) == " ".join(map(str, ids))
    r = bpe_stream.encode_documents(docs(spark, [(1, "ab" * 6000)]), WORD).first()
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, t.encode("ab" * 6000, add_special_tokens=False).ids)).encode()).hexdigest()


def test_language_needs_a_letter(spark, model):
    got = {r.doc_id: r.lang_pred for r in crf_langid.predict(docs(spark, [(1, "́́"), (2, "12 ́"), (3, "the and house")]), model).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}
    many = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        crf_langid.learn(many, labels=5)


def test_pii_beyond_the_base():
    def kinds(t):
        return [(k, t[a:b]) for k, a, b in pii.find(t)]

    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert kinds("account number 12345678, konto: 99887766") == [("account", "12345678"), ("account", "99887766")]
    assert kinds("at 12 Baker Street, in der Hauptstraße 12b, 12 bis, rue de la Paix") == [("address", "12 Baker Street"), ("address", "Hauptstraße 12b"), ("address", "12 bis, rue de la Paix")]
    for clean in ["the token ring: 5", "accounts 123 no", "broad 12 lane", "secret = something else", "passwords"]:
        assert kinds(clean) == []


def test_pipeline_on_odd_tables(spark):
    odd = clash(docs(spark, [*TEXTS, (20, draw(90)), (None, None)]).withColumn("n_chars", F.lit(1).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, odd.where("false"), "")
        assert empty.count() == 0 and empty.columns == odd.columns
    kept = corpus_pipeline.near(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == odd.count()
    left = corpus_pipeline.repeats(spark, odd, "")
    assert left.columns == odd.columns
    red = corpus_pipeline.personal(spark, odd, "")
    assert red.columns == odd.columns and red.count() == odd.count()
    assert corpus_pipeline.packed(spark, odd, "").count() >= odd.count()


def test_all_are_registered():
    assert len(registry.queries()) == 10 and all(q.__doc__ for q in registry.queries().values())


def test_language_sample_keeps_every_label(spark):
    """Null and repeated ids and large groups of copies lose no label, and each label is bounded by itself."""
    draw_of = lambda words: " ".join(rng.choices(words.split(), k=30))
    rows = [(None, draw_of("aba bab caba daba eba"), "aa") for _ in range(2000)] + [(7, draw_of("lul mul nul ulu umu"), "mm") for _ in range(300)]
    rows += [(3 * i, draw_of("xix yiz zix iziz xiz"), "zz") for i in range(400)] + [(None, "hot copy of one text " * 6, "hh")] * 1500 + [(None, None, "no"), (5, "", "ee")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = crf_langid.learn(d, per_label=50)
    assert set(m["labels"]) >= {"aa", "hh", "mm", "zz"}
    seen = []
    got = crf_langid.train
    try:
        crf_langid.train = lambda sample: seen.extend(sample) or {}
        crf_langid.learn(d, per_label=50)
    finally:
        crf_langid.train = got
    n = {y: sum(1 for x, _ in seen if x == y) for y in ("aa", "hh", "mm", "zz")}
    assert max(n.values()) <= 2 * 50 * 3 and min(n["aa"], n["mm"], n["zz"]) >= 40
    right = [r.lang_pred == r.lang for r in crf_langid.predict(d.where("lang IN ('aa', 'mm', 'zz')"), m, keep="lang").collect()]
    assert sum(right) > 0.98 * len(right)


def test_licence_lists_of_thousands_of_cue_lines(spark):
    """The work is in proportion to the cue lines; the licence is found among them, in a long line as well."""
    import time

    def scanned(n):
        lines = [f"package number {i} comes under a license of its own kind {i}" for i in range(n)]
        lines[n // 2] = "This work is licensed under the Apache License, Version 2.0"
        d = spark.createDataFrame([(1, "\n".join(lines)), (2, "; ".join(lines)), (3, "plain text")], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: r.licence for r in licences.scan(d, "doc_id", F.lit(None).cast("string"), "text").collect()}
        assert got == {1: "Apache-2.0", 2: "Apache-2.0", 3: None}
        return time.time() - began

    scanned(50)
    assert scanned(20_000) < 120
