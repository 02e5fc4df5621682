"""Spelling variant grouping (operator 11): near words by wildcard groups and deletions, without a pair of words.

A word with one place left out belongs to the group (place, prefix, suffix); the words of a group differ from each other
in that place alone. A group keeps its size and its two most frequent words, which tell each member how many replacements
it has and which is best: the first word, or the second for the first itself. For insertions and deletions the same
shortened words join the vocabulary: a word learns the number and the best of the longer words that a deletion leads to
it, and each longer word that this one stands there. A group holds one word for each letter of the alphabet at most, so
no key is hot, and the rows are twice a word's length and one. Forms are followed to their roots by pointer doubling; as
a form has at least twice the count, a chain of forms has no loop and is at most the logarithm of the largest count long.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import pick, read
from tallyweave.tables import Scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def vocabulary(df: DataFrame, id_col: str, text_col: str, delete: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of all whole texts with at least `shortest` code points and `least` occurrences.

    A word is a maximal run of Latin letters with A-Z lower-cased. Where `delete` divides h, the unsigned crc32 of
    `<id>:<run>`, its code point h % length is left out (0 leaves all as they are). Null and empty texts have no words; a
    null id counts as the empty string; rows that repeat an id or a text each count.
    """
    docs = pick(df, id_col, text_col).toDF("id", "text")
    # The outer form: the inner one has Spark filter on the runs' number first, that is, search each text twice.
    run = F.explode_outer(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), run).where("run IS NOT NULL")
    word = F.col("run")
    if delete:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % delete == 0, _without(F.col("run"), at)).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _without(word: Column, at: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + F.lit(2), F.length(word)))


def near(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best struct<m, near>) of a table (word, n) whose words are distinct.

    Near words differ by exactly one inserted, deleted or replaced code point; the best is the one of largest n (m is -n,
    so that the smallest struct is the best; ties by code points). A word without any has 0 and null.
    """
    places = F.sequence(F.lit(0), F.length("word") - 1)
    short = F.transform(places, lambda i: _without(F.col("word"), i))
    key = lambda at, rest, kind: F.struct(at.cast("int").alias("at"), rest.alias("rest"), F.lit(kind).alias("kind"))
    wild = F.transform(short, lambda s, i: key(i, s, "wild"))
    gone = F.transform(F.array_distinct(short), lambda s: key(F.lit(-1), s, "gone"))
    own = F.array(key(F.lit(-1), F.col("word"), "own"))
    some = F.when(F.length("word") > 0, F.concat(own, gone, wild)).otherwise(own)
    rows = words.select("word", "n", F.struct((-F.col("n")).alias("m"), F.col("word").alias("near")).alias("me"), F.explode(some).alias("k"))
    rows = rows.select("word", "n", "me", "k.at", "k.rest", "k.kind")
    whole = Window.partitionBy("at", "rest").orderBy(F.col("kind") == "own", "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The vocabulary's own row comes last, so the first two rows are the group's two most frequent other words.
    rows = rows.select("word", "n", "me", "kind", F.count("*").over(whole).alias("size"), F.first("me").over(whole).alias("first"), F.nth_value("me", 2).over(whole).alias("second"), F.last(F.when(F.col("kind") == "own", F.col("me"))).over(whole).alias("there"))
    count = F.when(F.col("kind") != "gone", F.col("size") - 1).when(F.col("there").isNotNull(), 1).otherwise(0)
    best = F.when(F.col("kind") == "gone", F.col("there")).when(F.col("size") > 1, F.when((F.col("kind") == "wild") & (F.col("first.near") == F.col("word")), F.col("second")).otherwise(F.col("first")))
    told = rows.select("word", "n", count.alias("c"), best.alias("best")).where((F.col("c") > 0) | (F.col("kind") == "own"))
    return told.groupBy("word", "n").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of a written table (word, form): form after form to the last.

    Each round replaces what a word points to by what that points to, so a chain of length c takes log2 c rounds.
    """
    hops = scratch.cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "hops")
    while True:
        on = hops.select(F.col("word").alias("mid"), F.col("to").alias("far"))
        step = hops.join(on, F.col("to") == F.col("mid"), "left")
        step = scratch.cut(step.select("word", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("more")), "hops")
        scratch.drop(hops)
        if step.where("more").isEmpty():
            break
        hops = step
    return forms.select("word").join(step.select("word", F.col("to").alias("root")), "word", "left").select("word", F.coalesce("root", "word").alias("root"))


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) whose words are distinct.

    A word's form is its best near word, if that occurs at least twice as often, else null; the root is reached by
    following forms. An empty table gives an empty one; null words are left out.
    """
    scratch = Scratch(words.sparkSession)
    d = near(pick(words, "word", "n").where("word IS NOT NULL"))
    form_n = -F.col("best.m")
    fits = F.col("best").isNotNull() & (form_n >= 2 * F.col("n"))
    d = d.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", "n_near", F.when(fits, form_n).alias("form_n"))
    forms = scratch.cut(d, "forms")
    out = forms.join(roots(forms.select("word", "form"), scratch), "word").select("word", "form", "root", "n", "n_near", "form_n")
    return scratch.end(out, "variants")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(read(spark, sf_dir, "documents"), "doc_id", "text"))


def _crc32(text: str) -> str:
    """DuckDB's crc32 of a text in ASCII and U+00C0 to U+00FF: a fold over its bytes with the table of the reversed
    polynomial 0xEDB88320."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    data = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1))), 4294967295)"


#: Pairs, not groups: each two words that share a word with one place left out.
SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tag, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, c, {_crc32("tag")} AS h FROM runs),
words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 200) r(i) WHERE i <= length(word)),
pairs AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM cuts a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM cuts a JOIN words w ON a.rest = w.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN m >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.at AND e.form IS NULL
"""
