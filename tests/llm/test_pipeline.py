import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as c
from tallyweave.llm import minhash, pii

random.seed(9)
EN, FR = ["the", "and", "with", "this", "that"], ["les", "des", "avec", "cette", "dans"]


def prose(words, n):
    return " ".join(random.choice(words) if i % 3 else "".join(random.choices("abdeilmnorstu", k=6)) for i in range(n))


def test_stages_against_brute_force(spark, tmp_path):
    texts = [prose(EN if i % 2 else FR, 80) for i in range(40)]
    passage = prose(EN, 70)
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s", 1), (101, texts[3].replace("the", "tho", 1), "en", "s", 1), (102, "12 34", "en", "s", 5), (103, None, "fr", "s", None)]
    rows += [(104, prose(EN, 40) + " " + passage, "en", "s", 1), (105, passage + " " + prose(EN, 60) + " mail x.y@z.org", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in v} for n, v in seen.items()}
    assert ids["language"] == {r[0] for r in rows} - {102, 103}
    sets = {r.doc_id: set(minhash.shingles(r.text).tolist()) for r in seen["language"]}
    twins = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert ids["near_duplicates"] == set(sets) - twins and {100, 101} <= twins
    left = {r.doc_id: r for r in seen["repeated_passages"]}
    assert all(left[i].text == t for i, t in enumerate(texts)) and passage in left[104].text and passage[:200] not in left[105].text
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert all(r.text == pii.redact(left[r.doc_id].text) for r in seen["personal_data"]) and any("[EMAIL]" in r.text for r in seen["personal_data"])
    t, final = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in seen["personal_data"]}
    assert {r.doc_id: r.length for r in seen["packing"]} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in final.items()}
    fill = np.bincount([r.sequence_id for r in seen["packing"]], weights=[r.length for r in seen["packing"]])
    assert fill.max() <= 2048 and len(fill) <= -(-fill.sum() // 2048) + 1


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(21)
    draw = lambda words, n: " ".join(rng.choice(words) if i % 3 else "".join(rng.choices("abdeilmnorstu", k=6)) for i in range(n))
    rows = [(i, draw(EN if i % 2 else FR, 80), "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    passage = draw(EN, 70)
    null, twin, first, second = draw(EN, 80), draw(FR, 80), draw(EN, 40) + " " + passage, draw(FR, 90)
    cutdown = passage + " " + draw(EN, 60)
    rows += [(None, null, "en", "s", 1), (None, null, "en", "s", 1), (None, "12 34", "en", "s", 1), (None, None, "en", "s", 1)]
    rows += [(50, "12 34", "en", "s", 1), (50, first, "en", "s", 1), (50, second, "fr", "s", 1), (51, twin, "fr", "s", 1), (51, twin, "fr", "s", 1), (52, cutdown, "en", "s", 1), (52, draw(FR, 80), "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/in")
    docs, seen = spark.read.parquet(f"{tmp_path}/in"), []
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    of = lambda k: sorted(((r.doc_id or -1, r.text) for r in seen[k]))
    clean = sorted((r[0] or -1, r[1]) for r in rows if r[1] not in ("12 34", None))
    assert of(0) == clean
    clean.remove((51, twin))
    assert of(1) == clean
    left = of(2)
    assert len(left) == len(clean) and [x for x in left if x not in clean] == [x for x in left if x[0] == 52 and x[1] in cutdown] and len(set(clean) - set(left)) == 1
    assert of(3) == left and len({(r.doc_id, r.sequence_id, r.offset) for r in seen[4]}) == len(seen[4]) >= len(left)
