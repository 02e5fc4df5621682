"""Licence scans (operator 9), native: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Of each file, with or without a licence cue, the whole text is a unit; of cue lines there are blocks of several lines
(headers, and notices wrapped over lines), the lines, their sentences, and windows of words at a cue in long ones. A term
weighs how often the unit has it times its inverse document frequency, counted over all files. Each unit is compared with
each template (whole licences, headers, short notices) by sparse cosine; what a bound that loses none shows to be under
the threshold is left out first. At or over the threshold, whole licences and
headers come before short notices, and those before the reservation of rights that many licences hold; within these the
best score is the file's own licence. A file without one inherits from the nearest ancestor directory in which a licence
file was found; if the files of a directory state several, the most common one counts (ties by name).
"""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import pick, read
from tallyweave.tables import Scratch

#: Short forms of licence notices.
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted bsd license",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "subject to the terms of the mozilla public license version 2.0",
    "Proprietary": "all rights reserved",
}
#: Titles and notices without a verb; licence texts and headers are files.
MORE = [("MIT", "mit license"), ("MIT", "licensed under the mit license")]
TEXTS = Path(__file__).with_name("licence_texts")
_CUE = r"(?i)licen[cs]e|copyright|rights reserved|spdx|redistribution|permission is hereby granted"
_CUE_TERM = r"^(licen[cs]e|copyright|reserved|spdx|redistribution|permission)"
_TERM = r"([a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*)"
#: Lines of a block, and words before a cue and of a window.
BLOCKS, WINDOWS = (2, 3, 4, 8, 12, 16, 24), ((0, 6), (2, 5), (4, 7), (5, 8), (6, 10), (7, 10))

#: Hash values of terms in the first bound on whole texts.
SLOTS = 1 << 16


def templates() -> list[tuple[int, str, int, list[str]]]:
    """(number, licence, rank, terms); the lowest rank counts first."""
    out = [(f.name.removesuffix(".txt").removesuffix(".header"), 0, f.read_text()) for f in sorted(TEXTS.glob("*.txt"))]
    out += [(k, 2 if k == "Proprietary" else 1, v) for k, v in [*TEMPLATES.items(), *MORE]]
    return [(i, k, r, re.findall(_TERM, v.lower())) for i, (k, r, v) in enumerate(out)]


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(1))


def units_of(texts: DataFrame) -> DataFrame:
    """(id, terms) of the units at cue lines of texts (id, text): a row each, whatever a text's number of cue lines.

    A cue line goes on with the lines around it alone, so the work is in proportion to the cue lines; units may repeat.
    """
    lines = texts.withColumn("lines", F.filter(F.split("text", "[\r\n]+"), lambda x: F.trim(x) != ""))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: F.coalesce(F.get("lines", i - 1).rlike(_CUE), F.lit(False)))
    # The line before a cue line, itself, and as many as the longest block takes; the first line has none before it.
    around = F.transform(at, lambda i: F.struct(F.slice("lines", F.greatest(i - 1, F.lit(1)), BLOCKS[-1] + 1).alias("ls"), F.least(i, F.lit(2)).alias("own")))
    cue = lines.select("id", F.explode_outer(around).alias("a")).where("a IS NOT NULL").select("id", "a.ls", "a.own", F.element_at("a.ls", F.col("a.own")).alias("line"))
    blocks = [F.array_join(F.slice("ls", F.greatest(F.col("own") - d, F.lit(1)), n), " ") for n in BLOCKS for d in (0, 1)]
    sentences = F.filter(F.split("line", "(?<=[.;!?])\\s+"), lambda x: x.rlike(_CUE))
    cue = cue.select("id", F.array(*blocks, F.col("line")).alias("blocks"), sentences.alias("sentences"))
    own = cue.select("id", F.explode(F.array_distinct(F.concat("blocks", "sentences"))).alias("unit")).select("id", _terms(F.col("unit")).alias("terms"))
    long = cue.select("id", F.explode_outer("sentences").alias("s")).where("s IS NOT NULL").select("id", _terms(F.col("s")).alias("t")).where(F.size("t") > 8)
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i).rlike(_CUE_TERM))
    windows = F.flatten(F.transform(places, lambda i: F.array(*[F.slice("t", F.greatest(i - d, F.lit(1)), n) for d, n in WINDOWS])))
    windows = long.select("id", F.explode_outer(windows).alias("terms")).where("terms IS NOT NULL")
    return own.union(windows)


def _slot(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(SLOTS))


def _may_reach(terms: Column, df_of: DataFrame, weights: DataFrame, idf: Column, least: float) -> Column:
    """Whether a text's terms may reach the least cosine with a template, row by row, by a bound that loses none.

    Terms are looked up by slot. In the product with a template a term counts as the heaviest of the template's in its slot,
    in the text's own length by the smallest idf there, so the first is never too small and the second never too large.
    """
    low, place = ["1"] * SLOTS, ["-1"] * SLOTS  # as many numbers as there are slots
    for r in df_of.groupBy(_slot(F.col("term")).alias("slot")).agg(F.min(idf).alias("low")).collect():
        low[r.slot] = repr(r.low * (1 - 1e-9))
    heaviest = F.max(F.col("v") / F.col("tf") * F.col("v") / F.col("norm"))
    found = weights.groupBy(_slot(F.col("term")).alias("slot"), "template").agg(heaviest.alias("w")).collect()  # fixed size
    at = {slot: i for i, slot in enumerate(sorted({r.slot for r in found}))}
    for slot, i in at.items():
        place[slot] = str(i)
    each = {t: ["0"] * len(at) for t in sorted({r.template for r in found})}
    for r in found:
        each[r.template][at[r.slot]] = repr(r.w * (1 + 1e-9))
    array = lambda xs, kind: F.split(F.lit(",".join(xs)), ",").cast(f"array<{kind}>")
    low, place, each = array(low, "double"), array(place, "int"), {f"t{t}": array(xs, "double") for t, xs in each.items()}

    def longer(a: Column, x: Column) -> Column:
        run = F.when(a["term"].eqNullSafe(x), a["run"] + 2.0).otherwise(1.0)  # 1 + 3 + 5 + ... is a square
        w = F.get(low, _slot(x))
        return F.struct(x.alias("term"), run.alias("run"), (a["size"] + run * w * w).alias("size"))

    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("size"))
    size = lambda ts: F.aggregate(F.sort_array(ts), none, longer, lambda a: F.sqrt(a["size"]))
    hits = lambda ts: F.filter(F.transform(ts, lambda x: F.get(place, _slot(x))), lambda i: i >= 0)
    start = F.struct(*[F.lit(0.0).alias(t) for t in each])
    dot = lambda ts: F.aggregate(hits(ts), start, lambda a, i: F.struct(*[(a[t] + F.get(w, i)).alias(t) for t, w in each.items()]), lambda a: F.greatest(*[a[t] for t in each]))
    # As the item of an array the terms are found once, not once for each use.
    return F.get(F.transform(F.array(terms), lambda ts: dot(ts) >= (least - 1e-6) * size(ts)), F.lit(0))


def _promising(units: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(unit) of units (unit, terms) that may reach the least cosine, by a bound that loses none.

    Only terms of templates add to a product, so the squared cosine is at most their share in the unit's squared length.
    Terms of no template weigh 1 or more each time they occur, which bounds the rest from below without their frequencies.
    """
    idf = F.max(F.col("v") / F.col("tf"))
    known = F.broadcast(weights.groupBy("term").agg(idf.alias("idf")))  # the terms of the templates
    d = units.select("unit", F.explode(F.split("terms", " ")).alias("term")).join(known, "term", "left")
    d = d.groupBy("unit", F.when(F.col("idf").isNotNull(), F.col("term")).alias("known")).agg(F.count("*").alias("n"), F.max("idf").alias("idf"))
    own, rest = F.sum(F.pow(F.col("n") * F.col("idf"), 2)), F.sum(F.when(F.col("idf").isNull(), F.col("n")).otherwise(0))
    d = d.groupBy("unit").agg(F.coalesce(own, F.lit(0.0)).alias("own"), rest.alias("rest"))
    return d.where(F.col("own") >= (least * least - 1e-6) * (F.col("own") + F.col("rest"))).select("unit")


def scan(df: DataFrame, id_col: str, path: Column, text_col: str, least: float = 0.7, few: int = 1 << 16) -> DataFrame:
    """(id, path, licence, score, inherited_from) for each row of df.

    Null or empty texts state no licence; a null path has no directory and inherits nothing. Rows that repeat an id share
    its licence; a null id states none. Ties go to the licence that is first by name. An empty table gives an empty one;
    other columns are not looked at.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    own = f"path_{uuid.uuid4().hex}"  # no column of df has this name
    d = pick(df.select("*", path.alias(own)), id_col, text_col, own).toDF("id", "text", "path")
    stating = d.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text")
    words = _terms(F.col("text"))
    n = stating.count()
    known = spark.createDataFrame([(i, k, r, w, float(t.count(w))) for i, k, r, t in templates() for w in set(t)], "template int, licence string, rank int, term string, tf double")  # fixed size
    df_of = scratch.cut(stating.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    idf = F.log((F.lit(1.0 + n)) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 1.0
    weights = known.join(df_of, "term", "left").select("template", "licence", "rank", "term", "tf", (F.col("tf") * idf).alias("v"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    weights = scratch.cut(weights.join(norms, "template"), "weights")
    whole = stating.select("id", words.alias("terms")).where(_may_reach(F.col("terms"), df_of, weights, idf, least))
    cued = scratch.cut(stating.where(F.col("text").rlike(_CUE)), "cued")
    every = whole.union(units_of(cued)).select("id", F.array_join("terms", " ").alias("terms")).where("terms <> ''")
    every = scratch.cut(every.select("id", F.unhex(F.md5("terms")).alias("unit"), "terms"), "units")
    units = scratch.cut(every.groupBy("unit").agg(F.first("terms").alias("terms")), "distinct")
    units = scratch.cut(units.join(_promising(units, weights, least), "unit", "left_semi"), "promising")
    counts = units.select("unit", F.explode(F.split("terms", " ")).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    own_terms = scratch.cut(counts.join(df_of, "term").select("unit", "term", (F.col("tf") * idf).alias("w")), "vectors")
    size = own_terms.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"))
    dot = own_terms.join(F.broadcast(weights), "term").groupBy("unit", "template", "licence", "rank", "norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    close = dot.join(size, "unit").select("unit", "licence", "rank", F.round(F.col("dot") / F.col("norm") / F.col("size"), 9).alias("score")).where(F.col("score") >= least)
    best = close.groupBy("unit").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "licence")).alias("b"))
    own = every.select("id", "unit").distinct().join(best, "unit").groupBy("id").agg(F.min("b").alias("b")).select("id", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("own_score"))
    files = scratch.cut(d.select("id", "path").join(own, "id", "left"), "files")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    dirs = F.when(F.size(parts) > 1, up)
    stated = files.where("own IS NOT NULL").select(F.element_at(dirs, 1).alias("dir"), "own").where("dir IS NOT NULL").groupBy("dir", "own").agg(F.count("*").alias("n"))
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("s")).select("dir", F.col("s.own").alias("theirs"))
    # Directories, not files, look for their ancestors: once each, however many files they hold.
    mine = files.where("own IS NULL").select(F.element_at(dirs, 1).alias("home"), dirs.alias("dirs")).where("home IS NOT NULL").distinct()
    near = mine.select("home", F.posexplode("dirs").alias("far", "dir")).join(stated, "dir").groupBy("home").agg(F.min(F.struct("far", "dir", "theirs")).alias("x"))
    # Directories are few beside their files, and one may hold a third of these: up to `few` of them go to every task.
    near = scratch.cut(near, "near")
    out = files.withColumn("home", F.when(F.col("own").isNull(), F.element_at(dirs, 1))).join(F.broadcast(near) if near.count() <= few else near, "home", "left")
    out = out.select("id", "path", F.coalesce("own", "x.theirs").alias("licence"), F.coalesce("own_score", F.lit(0.0)).alias("score"), F.when(F.col("own").isNull(), F.col("x.dir")).alias("inherited_from"))
    return scratch.end(out, "licences").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a file's directory is its source and language."""
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return scan(read(spark, sf_dir, "documents"), "doc_id", path, "text")
