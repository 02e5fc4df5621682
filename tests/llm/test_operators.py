import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from tokenizers import Tokenizer

from tallyweave.llm import ann, bpe_stream, crf_langid, licences, minhash, packing, pii, substring, topk, url_filter

random.seed(3)
WORDS = ["".join(random.choices("abdeghiklmnorstu", k=random.randint(2, 9))) for _ in range(3000)]
PROSE = [" ".join(random.choices(WORDS, k=random.randint(60, 200))) for _ in range(30)]
DOCS = "doc_id long, text string, lang string, n_shingles int, rank string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", 1, "x") for i, t in enumerate(texts)], DOCS)


def brute_pii(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_pii_matches_regexes(spark):
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+27 82 555-1234", "+1", "+12", "é@é.com", " ", "..", "foo", "00001.2.3.4", "a@b.c@d.e", "-", "+1(2)3.4.5.6 78"]
    texts = ["".join(random.choices(parts, k=8)) for _ in range(3000)] + ["".join(random.choices("0123.+@ a-", k=60)) for _ in range(3000)]
    for t in texts:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute_pii(t), t
    rows = {r.doc_id: r for r in pii.find_spans(docs(spark, [None, "", "a@b.co 10.0.0.1"])).collect()}
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == "email:0:6,ip:7:15" and rows[2].n_ip == 1
    assert pii.redact("mail a@b.co now") == "mail [EMAIL] now" and pii.redact("clean") == "clean"


def test_bpe_matches_library():
    m, t = bpe_stream.model(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for x in [*PROSE[:10], "", "Σας ΟΔΟΣ", "a\x1cb", "<|endoftext|> Hi<|startoftext|>", "é é", "ab" * 6000, "日本語 😀", "can't 123 !!--", "\x85a"]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert m.encode(x) == (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
        d = bpe_stream.Decoder(m)
        assert "".join(map(d.push, ids)) == m.encode(x)[1]
    d = bpe_stream.Decoder(m, names=False)
    assert "".join(map(d.push, t.encode("héllo wörld", add_special_tokens=False).ids)) + d.finish() == "héllo wörld "
    word = "".join(random.choices("abcdefgh", k=20000))
    assert list(m.stream(word[i : i + 333] for i in range(0, len(word), 333))) == m.merge([*word[:-1], word[-1] + "</w>"])


def test_bpe_query_decodes_ids(spark, monkeypatch):
    path = P.path("word_bpe_49k.json")
    t, m = Tokenizer.from_file(path), bpe_stream.BpeModel(path)
    texts = ["", *PROSE[:4], "a <|endoftext|> Hi<|startoftext|>", "é 😀 ab\x1cc", " ".join(PROSE) * 2]
    for x in texts:
        assert " ".join(m.encode_parts(x, 7)) == m.encode(x)[0]

    def digests():
        return [next(bpe_stream.encode_documents(docs(spark, [x]), path).toLocalIterator()) for x in texts]

    for x, r in zip(texts, digests(), strict=True):
        ids = t.encode(x, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    plain = bpe_stream.Decoder(m, names=False)
    assert plain.push_all(m.encode("héllo wörld")[0].split(" ")) + plain.finish() == "héllo wörld "
    # A fault of decoding shows in the query's digest.
    from functools import partial

    class Told(Exception):
        pass

    def fail(self, ids):
        raise Told

    monkeypatch.setattr(bpe_stream.Decoder, "push_all", fail)
    taken = {}
    monkeypatch.setattr(type(docs(spark, [])), "mapInArrow", lambda self, run, schema: taken.setdefault("run", partial(run)))
    bpe_stream.encode_documents(docs(spark, ["a"]), path)
    import pyarrow as pa
    import pytest

    with pytest.raises(Told):
        list(taken["run"](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], ["doc_id", "text"])])))


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", *PROSE, PROSE[0], " ".join(PROSE) * 3, "a  b \n c", "<|endoftext|>x"]
    rows = packing.pack_documents(docs(spark, texts), P.path("byte_bpe_50k.json")).collect()
    places = {}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            import zlib

            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_minhash_matches_brute_force(spark):
    base = PROSE[0].split()
    near = [" ".join(w if random.random() > 0.02 else "zz" for w in base) for _ in range(25)]
    texts = [None, " \t", "one two", "One  TWO", *PROSE, *near, PROSE[3].upper(), PROSE[4] + " tail"]
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(len(texts))}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_substring_finds_fuzzy_passage(spark):
    passage = random.choices(WORDS, k=70)
    fuzzy = [w if i % 17 else "qq" for i, w in enumerate(passage)]
    texts = [None, "", PROSE[0] + " " + " ".join(passage) + " " + PROSE[1], PROSE[2] + " " + " ".join(fuzzy), PROSE[5], PROSE[6]]
    rows = substring.passages(docs(spark, texts)).collect()
    assert {(r.doc_id, r.partner) for r in rows} == {(3, 2)} and max(r.end_word - r.start_word for r in rows) >= 60
    left = {r.doc_id: r.text for r in substring.remove(docs(spark, texts)).collect()}
    assert left[2] == texts[2] and left[4] == texts[4] and left[0] is None and left[3].startswith(PROSE[2][:50]) and len(left[3].split()) < len(texts[3].split()) - 55


def test_substring_aligns_over_one_edit(spark):
    rng = random.Random(11)
    draw = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    texts, want = [], []
    for n in (50, 60, 70, 100):
        for t in range(1, n):
            passage = draw(n)
            edited = passage[:t] + draw(1) + passage[t:] if t % 2 else passage[:t] + passage[t + 1 :]
            want.append((len(texts) + 1, n - 1 if t % 2 == 0 else n, t, n))
            texts += [" ".join(draw(60) + passage + draw(60)), " ".join(draw(50) + edited + draw(50))]
    got = {}
    for r in substring.passages(docs(spark, texts)).collect():
        got[r.doc_id] = max(got.get(r.doc_id, 0), r.n_same)
    for i, same, t, n in want:  # an end of under three words between the edit and other text can't be told from chance
        near = min(t, n - t)
        assert got.get(i, 0) >= same - (near if near <= 3 else 0), (n, t, got.get(i))


def test_substring_later_holders_meet(spark):
    rng = random.Random(12)
    draw = lambda n: " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(n))
    texts, want = [], []
    for n in (14, 20, 26):
        for _ in range(40):  # each line was seen before in a document of its own
            lines = [draw(n) for _ in range(3)]
            at = len(texts)
            texts += [f"{draw(30)} {x} {draw(30)}" for x in lines] + [f"{draw(40)} {' '.join(lines)} {draw(40)}", f"{draw(60)} {' '.join(lines)} {draw(60)}"]
            want.append((at + 4, at + 3, 3 * n))
    got = {(r.doc_id, r.partner): r.n_same for r in substring.passages(docs(spark, texts)).collect() if r.partner % 5 == 3}
    assert all(got.get((b, a)) == n for b, a, n in want)


def test_substring_matches_are_whole(spark):
    rng = random.Random(13)
    rows = sorted({(h, rng.randrange(60), rng.randrange(500)) for h in [7] * 300 + list(range(40)) * 4})
    found = spark.createDataFrame(rows, "h long, id long, at int")
    by_seed, want = {}, set()
    for h, i, at in rows:
        by_seed.setdefault(h, []).append((i, at))
    for h, held in by_seed.items():
        for i, at in held:
            before = [x for x in held if x[0] < i]
            want |= {(i, *x[:1], at, x[1]) for x in before[:1] + before[-1:]}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {tuple(r) for r in substring.matches(found)[0].collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def edited_passages(every, trials, n=60, seed=14):
    """Texts in pairs that share a passage of n words, one word replaced every so many."""
    rng = random.Random(seed)
    draw = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    texts = []
    for _ in range(trials):
        passage, shift = draw(n), rng.randrange(every)
        edited = [w if (i + shift) % every else draw(1)[0] for i, w in enumerate(passage)]
        texts += [" ".join(draw(60) + passage + draw(60)), " ".join(draw(50) + edited + draw(50))]
    return texts


def test_substring_recall_between_edits(spark):
    for every, least in ((9, 100), (7, 98), (6, 93)):
        texts = edited_passages(every, 100)
        found = {r.doc_id // 2 for r in substring.passages(docs(spark, texts)).collect() if r.partner == r.doc_id - 1 and r.n_same >= 30}
        assert len(found) >= least, (every, len(found))


def test_url_filter(spark):
    rows = [(1, "http://A.Example.COM/en/71?x"), (2, None), (3, "nope"), (4, "https://x.net/de/1#y"), (5, "https://sub.example.net/de/89"), (6, "http://org/es/"), (7, "http://notexample.com/en/7")]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.CONTRACT_RULES).collect()}
    assert got[1] == ("a.example.com", "example.com/en/7", "allow") and got[2] == ("", None, "allow") and got[3] == ("", None, "allow")
    assert got[4][1:] == ("net/de/", "allow") and got[5][1:] == ("example.net/de/8", "block") and got[6][1:] == ("org/es/", "block") and got[7][1:] == ("com/en/", "block")


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<double>")


def test_topk_exact(spark):
    x = np.random.default_rng(0).normal(size=(300, 8)) / 3
    x[100:160] = x[50]
    got = topk.top_k(vectors(spark, x, [(900, None), (950, [None] * 8), (1000, [float("nan")] * 8), (1050, [])])).collect()
    q = np.floor(256 * x).astype(np.int64)
    want = [(i, r + 1, int(j), int(s)) for i in range(0, 300, 50) for r, (s, j) in enumerate(sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]) for s in [-s]]
    assert sorted(map(tuple, got)) == want
    assert topk.top_k(vectors(spark, x[:3])).count() == 2 and topk.top_k(vectors(spark, x[:0])).count() == 0


def test_ann_recall(spark):
    x = np.random.default_rng(1).normal(size=(2000, 32))
    x[500:520] = x[100]
    got = {}
    for r in ann.nearest(vectors(spark, x, [(3000, [0.0] * 32), (3100, None)])).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for i in range(0, 2000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hit += len({v for _, v, _ in got[i]} & set(np.lexsort((np.arange(2000), d))[:10].tolist()))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in got[i])
    assert hit >= 0.9 * 200 and [v for _, v, _ in sorted(got[100])] == list(range(500, 510))


def test_licences_inherit(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x", "nothing"), (3, "z/y", "text"), (4, "a/b/q", "x\nLicensed under the Apache License, Version 2.0.\ny"), (5, None, None), (6, "a/b/c/d", "license plates are on cars")]
    got = {r.id: (r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", spark_col("path"), "text").collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", "a/b/"), 3: (None, None), 4: ("Apache-2.0", None), 5: (None, None), 6: ("Apache-2.0", "a/b/")}


def test_licence_texts_headers_and_wrapped_lines(spark):
    text = {f.name.removesuffix(".txt"): f.read_text() for f in licences.TEXTS.glob("*.txt")}
    code = "import os\n" * 3 + "{}\n" + "\n".join(f"def {w}(x): return {w}" for w in WORDS[:150])
    cases = [(k.removesuffix(".header"), v) for k, v in text.items()]
    cases += [("MIT", text["MIT"].replace("<year> <copyright holders>", "2019 Jo Doe").split("\n", 2)[2]), ("BSD-3-Clause", text["BSD-3-Clause"].replace("The Regents of the University of California", "2020, Jo Doe")), ("MIT", "MIT License")]
    cases += [(k, code.format("\n".join(f"# {x}" for x in text[f].splitlines()))) for k, f in (("Apache-2.0", "Apache-2.0.header"), ("GPL-3.0", "GPL-3.0.header"), ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0.header"))]
    cases += [("Apache-2.0", code.format("Licensed under the Apache\nLicense, Version 2.0")), ("MIT", " ".join(WORDS[:60]) + " released under the MIT License " + " ".join(WORDS[60:120])), (None, "license plates are on cars")]
    rows = [(i, f"d{i}/x", t) for i, (_, t) in enumerate(cases)] + [(100 + i, f"e{i}/y", t) for i, t in enumerate(PROSE)]
    got = {r.id: r.licence for r in licences.scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", spark_col("path"), "text").collect()}
    assert [(i, got[i], k) for i, (k, _) in enumerate(cases) if got[i] != k] == [] and not any(got[100 + i] for i in range(len(PROSE)))


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    t, sizes = rng.normal(size=(3, 3)), np.array([1, 5, 70, 33])
    score = rng.normal(size=(sizes.sum(), 3))
    post, _ = crf_langid.forward_backward(score, sizes, t)
    at = 0
    for n in sizes:
        e, tr = np.exp(score[at : at + n]), np.exp(t)
        a, b = [e[0]], [np.ones(3)]
        for i in range(1, n):
            a.append(a[-1] @ tr * e[i])
            b.append(tr @ (b[-1] * e[n - i]))
        p = np.array(a) * np.array(b[::-1])
        assert np.allclose(post[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_language(spark):
    en, fr = ["the", "and", "house", "with", "this", "that"], ["le", "les", "maison", "avec", "cette", "dans"]
    rows = [(i, " ".join(random.choices(en if i % 2 else fr, k=30)), "en" if i % 2 else "fr") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = crf_langid.learn(df)
    got = {r.doc_id: r for r in crf_langid.predict(df, m).collect()}
    assert all(got[i].lang_pred == y for i, _, y in rows) and any(r.held_out for r in got.values())
    odd = crf_langid.predict(docs(spark, [None, "", "123 !"]), m).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)} and crf_langid.learn(df.where("false")) is None


def test_language_of_unbroken_text(spark):
    rng = random.Random(15)
    en, fr = ["the", "and", "house", "with", "this", "that"], ["le", "les", "maison", "avec", "cette", "dans"]
    m = crf_langid.train([(y, rng.choices(ws, k=24)) for _ in range(80) for y, ws in (("en", en), ("fr", fr))])
    run = lambda ws: "".join(rng.choices(ws, k=4000))
    got = crf_langid.predict(docs(spark, [run(en)[:64] + run(fr)[:9936], run(fr)[:64] + run(en)[:9936], run(en)[:10000]]), m).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["fr", "en", "en"]
    assert all(crf_langid._WORD.findall("x" * n) == ["x" * min(64, n - i) for i in range(0, n, 64)] for n in (1, 64, 65, 1000))


def test_prefix_filter_loses_no_link(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        words = base[: rng.choice([50, 55, 60])]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(5)}"], [words[at], "y"]])
        texts.append(" ".join(words))
    sets = [minhash.shingles(t) for t in texts]
    own = spark.createDataFrame([(i, len(s), i // 2) for i, s in enumerate(sets)], "id long, n long, comp long")
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, s binary")
    found = {(r.a, r.b) for r in minhash.possible(own, full).collect()}
    assert all(a // 2 != b // 2 for a, b in found)
    for a in range(80):
        for b in range(a + 1, 80):
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if a // 2 != b // 2 and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


def test_a_match_that_comes_twice_counts_once():
    """Where a range begins within a seed its matches may come twice; chains don't depend on where ranges begin."""
    once = [(7, 3, 4 * i, 4 * i + 9) for i in range(12)]
    chained = lambda rows: [tuple(r.values()) for b in substring._chain_rows(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "partner", "at", "there"])])) for r in b.to_pylist()]
    assert chained(sorted([*once, once[5], once[11]])) == chained(once) == [(7, 3, 0, 49, 9, 58)]
