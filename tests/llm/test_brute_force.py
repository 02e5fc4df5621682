"""Passages and licences against versions that compare everything with everything."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyweave.llm import licences, substring

rng = random.Random(41)


def draw(n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_every_common_run_is_found(spark):
    """Words of a run of 30 or more that an earlier document holds too are in a passage, but for up to 7 at its ends: they
    may be held by a document alone that is neither the first nor the last holder of any seed there, as a window of 4 seeds
    of 5 words takes 8. Words that no earlier document holds near any common word are in none."""
    pool = [draw(rng.randrange(20, 90)) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = draw(rng.randrange(10, 60))
        for p in rng.sample(pool, rng.randrange(4)):
            a = rng.randrange(len(p) // 2)
            words += p[a : a + rng.randrange(15, 90)] + draw(rng.randrange(50, 90))
        texts.append(words)
    rows = substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    covered = {i: set() for i in range(len(texts))}
    for r in rows:
        assert r.partner < r.doc_id and r.n_same >= substring.LEAST
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    for j, b in enumerate(texts):
        must, may = set(), set()
        for a in texts[:j]:
            runs = [0] * (len(b) + 1)
            for x in a:  # runs[k]: the common run that ends before b[k], for this place of a
                runs = [0, *(runs[k] + 1 if b[k] == x else 0 for k in range(len(b)))]
                for k, n in enumerate(runs):
                    may |= {k - 1} if n else set()
                    must |= set(range(k - n + 7, k - 7)) if n >= substring.LEAST else set()
        assert must <= covered[j], (j, sorted(must - covered[j]))
        assert all(any(abs(k - m) <= 3 for m in may) for k in covered[j])


def terms(text):
    return re.findall(licences._TERM, text.lower())


def units(text):
    cue = re.compile(licences._CUE)
    lines = [x for x in re.split("[\r\n]+", text) if x.strip(" ")]
    out = [terms(text)]
    for i in (i for i, x in enumerate(lines) if cue.search(x)):
        out += [terms(" ".join(lines[max(i - d, 0) :][:n])) for n in licences.BLOCKS for d in (0, 1)]
        out.append(terms(lines[i]))
        for s in (s for s in re.split(r"(?<=[.;!?])\s+", lines[i]) if cue.search(s)):
            t = terms(s)
            out.append(t)
            if len(t) > 8:
                out += [t[max(k - d, 0) :][:n] for k, w in enumerate(t) if re.search(licences._CUE_TERM, w) for d, n in licences.WINDOWS]
    return out


def brute(files, least=0.7):
    cued = [t for _, _, t in files if t and re.search(licences._CUE, t)]
    df = Counter(w for t in cued for w in set(terms(t)))
    idf = lambda w: math.log((1 + len(cued)) / (1 + df[w])) + 1
    weigh = lambda ts: {w: n * idf(w) for w, n in Counter(ts).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(k, r, weigh(t)) for _, k, r, t in licences.templates()]
    own = {}
    for i, _, t in files:
        best = []
        for u in units(t) if t and re.search(licences._CUE, t) else []:
            v = weigh(u)
            for k, r, m in known:
                score = round(sum(x * m.get(w, 0) for w, x in v.items()) / size(v) / size(m), 9) if v else 0
                if score >= least:
                    best.append((r, -score, k))
        own[i] = min(best)[2] if best else None
    stated = {}
    for i, path, _ in files:
        if own[i] and "/" in (path or ""):
            stated.setdefault(path.rsplit("/", 1)[0] + "/", Counter())[own[i]] += 1
    out = {}
    for i, path, _ in files:
        up = (path or "").split("/")[:-1]
        near = next((d for d in ("/".join(up[:n]) + "/" for n in range(len(up), 0, -1)) if d in stated), None)
        out[i] = own[i] or (min((-n, k) for k, n in stated[near].items())[1] if near else None)
    return out


def test_licences_against_brute_force(spark):
    texts = [f.read_text() for f in sorted(licences.TEXTS.glob("*.txt"))]
    notices = [*licences.TEMPLATES.values(), "Released under the MIT License.", "All rights reserved. Copyright 2020 someone", "licensed under something else entirely by nobody", "no cue here", "the license plates of old cars are red", ""]
    files = []
    for i in range(60):
        body = " ".join(draw(rng.randrange(1, 40)))
        lines = [*(f"# {x}" for x in rng.choice(texts).splitlines()[: rng.randrange(1, 60)])] if i % 4 == 0 else [rng.choice(notices)]
        where = "/".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(4)))
        files.append((i, f"{where}/f{i}" if where else f"f{i}", "\n".join([body, *lines, body]) if i % 9 else rng.choice(texts)))
    files += [(100, None, notices[0]), (101, "a/b/x", None)]
    got = {r.id: r.licence for r in licences.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", F.col("path"), "text").collect()}
    assert got == brute(files)


def test_licences_of_texts_without_a_cue(spark):
    """Every text is compared with every template, whether or not it has a word that hints at a licence."""
    cue = re.compile(f"{licences._CUE}|{licences._CUE_TERM[1:]}", re.I)
    texts = [cue.sub("", f.read_text()) for f in sorted(licences.TEXTS.glob("*.txt"))]
    files = [(i, f"d{i}/x", t) for i, t in enumerate([*texts, "released under the mit", *(" ".join(draw(80)) for _ in range(40)), ""])]
    assert not any(re.search(licences._CUE, t) for _, _, t in files)
    known = [terms(" ".join(t)) for _, _, _, t in licences.templates()]
    df = Counter(w for _, _, t in files for w in set(terms(t)))
    weigh = lambda ts: {w: n * (math.log((1 + len(files)) / (1 + df[w])) + 1) for w, n in Counter(ts).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, _, t in files:
        v = weigh(terms(t))
        best = [(r, -round(sum(x * m.get(w, 0) for w, x in v.items()) / size(v) / size(m), 9), k) for (_, k, r, _), m in zip(licences.templates(), map(weigh, known)) if v]
        want[i] = min((b for b in best if b[1] <= -0.7), default=(0, 0, None))[2]
    got = {r.id: r.licence for r in licences.scan(spark.createDataFrame(files, "id long, path string, text string"), "id", F.col("path"), "text").collect()}
    assert got == want and sum(k is not None for k in want.values()) >= 5
