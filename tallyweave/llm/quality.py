"""Quality rules (operator 12), native: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Tokens are runs of ASCII letters, digits, underscores and all characters beyond ASCII, or runs of ASCII punctuation; a
document's features are its tokens and pairs of neighbouring tokens, hashed to BUCKETS buckets. One multinomial is counted over the
half of all trusted documents, the other over every document; both are smoothed by one. A document's
score is the mean over its features of the logarithm of their ratio, in whole units of 2^-20, so that it doesn't depend
on the order of sums. The threshold lies half way between the lowest thousandth of the trusted documents that are held
out of the counts, the other half, and the upper quartile of the untrusted ones held out, or at the former where that is
lower, and every document is judged by it. Every label takes part in one or the other. Fixed rules on words, symbols, lines and repeated windows come first. No Python runs on the executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import pick, read
from tallyweave.tables import Scratch

#: Buckets of the multinomials; units of a score, and of its coarse steps when scores are ranked.
BUCKETS, UNIT, STEP = 1 << 15, 1 << 20, 1 << 12
#: Labels up to which they go to every task; more meet the texts by a shuffle.
FEW = 1 << 20
#: A pair's bucket comes from those of its tokens, the first times this odd number.
PAIR = 20_011
WINDOW, FEWEST, REPEATED = 5, 10, 20
_SYMBOL = "[#*$%&|<>]"
_WORD = "[^\\x20\\x09-\\x0D]+"
_TOKEN = "[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-^`{-~]+"


def _bucket(number: Column) -> Column:
    return number.bitwiseAND(BUCKETS - 1).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """docs with the buckets `b` of the tokens of `text`, and then of pairs."""
    d = docs.withColumn("tokens", F.coalesce(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>")))
    d = d.withColumn("one", F.transform("tokens", lambda t: _bucket(F.xxhash64(t))))
    two = F.transform(F.slice("one", 1, F.greatest(F.size("one") - 1, F.lit(0))), lambda b, i: _bucket(b * PAIR + F.get("one", i + 1)))
    return d.withColumn("b", F.concat("one", two)).drop("tokens", "one")


def sample_of(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(id, trusted, held): the documents of either label, halved by hashes of their ids; all, or with `most` up to so
    many of each.

    Labels other than 0 and 1, of null ids, or that contradict each other take no part.
    """
    d = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    d = d.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r")
    d = d.select("id", (F.col("q") == 1).alias("trusted"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 1).alias("held"))
    if most is None:
        return d
    some = [d.where(F.col("trusted") == t).orderBy(F.xxhash64("id"), "id").limit(most) for t in (True, False)]
    return some[0].unionByName(some[1])


def _sent(sample: DataFrame, few: int) -> DataFrame:
    return F.broadcast(sample) if sample.count() <= few else sample


def weights(docs: DataFrame, sample: DataFrame, few: int = FEW) -> list[int]:
    """The logarithm of the ratio for each bucket; zeros where no document is trusted."""
    with_label = docs.join(_sent(sample, few), "id", "left")
    target = F.coalesce(F.col("trusted") & ~F.col("held"), F.lit(False))
    # The outer form: the inner one has Spark filter on the buckets' number first, that is, tokenise twice.
    counts = features(with_label.select(target.alias("target"), "text")).select("target", F.explode_outer("b").alias("bucket"))
    counts = counts.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("target").alias("target")).collect()  # BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0] * BUCKETS
    t, a = math.log(sum(target) + BUCKETS), math.log(sum(raw) + BUCKETS)
    return [round((math.log(x + 1) - t - math.log(y + 1) + a) * UNIT) for x, y in zip(target, raw, strict=True)]


def score(docs: DataFrame, model: list[int]) -> DataFrame:
    """docs with `score`, the mean weight of the features of `text` in whole units, rounded towards zero; null without any."""
    w = F.from_json(F.lit(json.dumps(model)), "array<bigint>")  # folded to a constant of BUCKETS numbers
    d = features(docs)
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, b: s + F.get(w, b))
    return d.withColumn("total", total).withColumn("score", F.expr("CASE WHEN size(b) > 0 THEN total DIV size(b) END")).drop("b", "total")


def threshold(docs: DataFrame, sample: DataFrame, model: list[int], few: int = FEW) -> int | None:
    """The lowest score that is kept; null (all are) without trusted documents.

    Of all scores held out. Counts by coarse step tell in which steps the ranks asked for lie, and only those are counted
    score by score, so neither a task nor the driver gathers the scores.
    """
    scratch = Scratch(docs.sparkSession)
    # Written first: conditions on a score repeat its expression with all weights, and Spark plans that for minutes.
    table = scratch.cut(score(docs.join(_sent(sample.where("held"), few), "id"), model).select("trusted", "score"), "held")
    held = table.where("score IS NOT NULL").withColumn("step", F.expr(f"CAST(floor(score / {STEP}) AS BIGINT)"))
    steps = held.groupBy("trusted", "step").agg(F.count("*").alias("n")).orderBy("trusted", "step").collect()  # bounded by the range of weights
    at, begins = {}, {}
    for trusted, p in ((True, 0.001), (False, 0.75)):
        own = [r for r in steps if r.trusted == trusted]
        place, upto = (sum(r.n for r in own) - 1) * p, 0
        for r in own:
            for k in {math.floor(place), math.ceil(place)}:
                if upto <= k < upto + r.n:
                    begins[trusted, r.step] = upto
            upto += r.n
        at[trusted] = place if own else None
    near = F.lit(False)
    for trusted, step in begins:
        near |= (F.col("trusted") == trusted) & (F.col("step") == step)
    ranked = held.where(near).groupBy("trusted", "step", "score").agg(F.count("*").alias("n")).orderBy("trusted", "score").collect()  # STEP rows a step
    scratch.drop(table)
    value = {}
    for r in ranked:
        upto = begins[r.trusted, r.step]
        begins[r.trusted, r.step] = upto + r.n
        for k in {math.floor(at[r.trusted]), math.ceil(at[r.trusted])}:
            if upto <= k < upto + r.n:
                value[r.trusted, k] = r.score

    def between(trusted: bool) -> float | None:
        place = at[trusted]
        if place is None:
            return None
        low, high = math.floor(place), math.ceil(place)
        return float(value[trusted, low]) if low == high else (high - place) * value[trusted, low] + (place - low) * value[trusted, high]

    good, bad = between(True), between(False)
    if good is None:
        return None
    return math.floor(good if bad is None else min(good, (good + bad) / 2))


def rules(docs: DataFrame) -> DataFrame:
    """docs with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and base_failed of `text`; null has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("text", text)
    d = d.withColumns({"words": F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))})
    # Windows by hash first; windows whose hashes meet are compared word by word.
    d = d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    starts = F.slice("h", 1, F.greatest(F.size("h") - WINDOW + 1, F.lit(0)))
    d = d.withColumn("hashes", F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("h", i + k) for k in range(1, WINDOW)])))
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("sorted", F.when(again, F.sort_array(placed)))
    window = lambda s: F.slice("words", s["i"] + 1, WINDOW)
    same = lambda a, b: (a["h"] == b["h"]) & (window(a) == window(b))
    twice = F.filter("sorted", lambda s, j: F.coalesce(same(s, F.get("sorted", j + 1)), F.lit(False)) | F.coalesce(same(s, F.get("sorted", j - 1)), F.lit(False)))
    d = d.withColumn("repeated", F.array_sort(F.transform(twice, lambda s: s["i"])))
    # A repeated window adds the words that the next one doesn't begin with.
    covered = F.transform("repeated", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("repeated", j + 1) - i, F.lit(WINDOW))))
    long = lambda c: c.cast("long")
    d = d.withColumns({
        "n_words": long(F.size("words")),
        "word_chars": long(F.length(F.array_join("words", ""))),
        "n_symbols": long(F.regexp_count("text", F.lit(_SYMBOL))),
        "n_dup_lines": long(F.size("lines") - F.size(F.array_distinct("lines"))),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0).cast("long")),
    })
    d = d.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    return d.drop("words", "lines", "h", "hashes", "sorted", "repeated")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None, few: int = FEW) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for each row of df.

    kept is false where the base rules fail, else whether the score reaches the threshold. Null and empty texts have no
    words and fail; their score is null. Each row is judged by itself, so null ids and rows that repeat one stay; without
    trusted documents all that the rules pass is kept. All labels take part, with `most` up to so many of each value; up
    to `few` of them are sent to every task. An empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession)
    docs = pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = scratch.cut(sample_of(labels, most), "labels")
    model = weights(docs, sample, few)
    least = threshold(docs, sample, model, few)
    scratch.drop(sample)
    d = score(rules(docs), model)
    good = F.lit(True) if least is None else F.coalesce(F.col("score") >= least, F.lit(True))
    d = d.withColumn("kept", ~F.col("base_failed") & good)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.col("score") / UNIT).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
