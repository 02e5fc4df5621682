"""Extracted values against gold labels: checks in long form, counters, comparisons of runs, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each field of a page is compared.
CONTAINS = ("barcode_text", "province", "municipality", "station_name", "officer")
EXACT = ("ballot_type", "page_number", "page_total", "voting_district", "registered_voters")
TOTALS = {"valid": "total_valid_votes", "spoilt": "total_spoilt_votes", "cast": "total_votes_cast", "special": "special_votes", "s24a": "section_24a_votes"}
CHECKS = "file string, field string, kind string, actual string, expected string, ok boolean"


def contains(actual: Column, expected: Column) -> Column:
    """Nothing expected is met by anything; otherwise text within text, without case."""
    return (F.coalesce(expected, F.lit("")) == "") | F.contains(F.upper(F.coalesce(actual, F.lit(""))), F.upper(expected))


def equals(actual: Column, expected: Column) -> Column:
    return expected.isNull() | actual.eqNullSafe(expected)


def compare_pages(pages: DataFrame, gold: DataFrame, votes: DataFrame, gold_votes: DataFrame) -> DataFrame:
    """(file, field, kind, actual, expected, ok): all checks of all labelled files.

    pages and gold: a row a file, with columns by the names above (missing ones are not compared); a gold field that is
    NULL is not stated. Votes, (file, party_code, votes): the union of both sides, an absent expectation is 0 and an absent
    reading a miss; of a code that a page has twice the last reading by row_index counts.
    """
    fields = [f for f in (*CONTAINS, *EXACT, *TOTALS.values()) if f in gold.columns and f in pages.columns]
    own = pages.select("file", *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    d = gold.select("file", *[F.col(f).cast("string").alias(f"e_{f}") for f in fields]).join(own, "file")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit("contains" if f in CONTAINS else "exact").alias("kind"), F.col(f"a_{f}").alias("actual"), F.col(f"e_{f}").alias("expected")) for f in fields])
    long = d.select("file", F.inline(rows)).where("expected IS NOT NULL")
    long = long.withColumn("ok", F.when(F.col("kind") == "contains", contains(F.col("actual"), F.col("expected"))).otherwise(equals(F.col("actual"), F.col("expected"))))
    read = votes.groupBy("file", "party_code").agg(F.max_by("votes", "row_index").alias("actual"))
    told = gold_votes.select("file", "party_code", F.col("votes").alias("expected"))
    both = read.join(gold.select("file"), "file").join(told, ["file", "party_code"], "full_outer").withColumn("expected", F.coalesce("expected", F.lit(0)))
    v = both.select("file", F.concat(F.lit("votes."), "party_code").alias("field"), F.when(F.col("expected") == 0, "blank_vote").otherwise("vote").alias("kind"), F.col("actual").cast("string").alias("actual"), F.col("expected").cast("string").alias("expected"), F.col("actual").eqNullSafe(F.col("expected")).alias("ok"))
    return long.unionByName(v)


def percent(hits: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * hits / total, 1))


def counters(checks: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: hits and totals of all checks, of those of slips (templates, (file, template), other than worksheets), and
    of the slips' votes, all, non-zero and blank."""
    slip = F.coalesce(F.col("template"), F.lit("iec_slip")) != "worksheet"
    vote = slip & F.col("kind").isin("vote", "blank_vote")
    sets = {"labeled": F.lit(True), "iec": slip, "heuristic_vote": vote, "nonzero_vote": slip & (F.col("kind") == "vote"), "blank_vote": slip & (F.col("kind") == "blank_vote")}
    d = checks.join(templates, "file", "left")
    return d.agg(*[F.count_if(own & (F.col("ok") if what == "hits" else F.lit(True))).alias(f"{k}_{what}") for k, own in sets.items() for what in ("hits", "total")])


def by_file(checks: DataFrame) -> DataFrame:
    """(file, hits, total, pct, misses): misses as 'field: actual (expected)' in order of fields."""
    miss = F.when(~F.col("ok"), F.concat(F.col("field"), F.lit(": "), shown(F.col("actual")), F.lit(" ("), shown(F.col("expected")), F.lit(")")))
    d = checks.groupBy("file").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"), F.array_sort(F.collect_list(miss)).alias("misses"))
    return d.select("file", "hits", "total", percent(F.col("hits"), F.col("total")).alias("pct"), "misses")


def shown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))


def vote_compare(votes: DataFrame, gold_votes: DataFrame) -> DataFrame:
    """(file, party_code, expected, heuristic, cnn, heuristic_ok, cnn_ok): two readers side by side, over all codes that a
    labelled file has on either side."""
    read = votes.join(gold_votes.select("file").distinct(), "file")
    d = read.join(gold_votes.withColumnRenamed("votes", "expected"), ["file", "party_code"], "full_outer").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return d.select("file", "party_code", "expected", "heuristic", "cnn", F.col("heuristic").eqNullSafe(F.col("expected")).alias("heuristic_ok"), F.coalesce(F.col("cnn") == F.col("expected"), F.lit(False)).alias("cnn_ok"))


def extra_votes(votes: DataFrame, gold_votes: DataFrame) -> DataFrame:
    """Readings over 0 of codes that the gold labels of the file don't have."""
    return votes.where("votes > 0").join(gold_votes, ["file", "party_code"], "left_anti")


def compare_runs(checks: DataFrame, runs: list[str]) -> DataFrame:
    """(file, hits of each run, best): checks have a column run; of equal runs the first of the list is the best."""
    d = checks.groupBy("file").pivot("run", runs).agg(F.count_if("ok"))
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(r), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(r).alias("run")) for i, r in enumerate(runs)]))
    return d.select("file", *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in runs], best["run"].alias("best"))


def report_lines(checks: DataFrame, templates: DataFrame, markdown: bool = True) -> DataFrame:
    """(at, line): a report, a summary and then a line a file, its misses after it. Lines are rows, in order of `at`."""
    c = counters(checks, templates)
    head = c.select(F.posexplode(F.array(*[F.concat(F.lit("| " if markdown else ""), F.lit(label), F.lit(" | " if markdown else ": "), F.col(f"{k}_hits").cast("string"), F.lit("/"), F.col(f"{k}_total").cast("string"), F.lit(" | " if markdown else " = "), F.coalesce(percent(F.col(f"{k}_hits"), F.col(f"{k}_total")).cast("string"), F.lit("—")), F.lit(" % |" if markdown else " %")) for k, label in (("labeled", "All fields"), ("iec", "Slips"), ("heuristic_vote", "Party votes"), ("nonzero_vote", "Non-zero votes"), ("blank_vote", "Blank rows"))])).alias("i", "line"))
    head = head.select(F.format_string("0 %02d", "i").alias("at"), "line")
    f = by_file(checks)
    line = F.concat(F.lit("| " if markdown else ""), F.col("file"), F.lit(" | " if markdown else ": "), F.col("hits").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" |" if markdown else ""))
    files = f.select(F.concat(F.lit("1 "), "file").alias("at"), line.alias("line"))
    misses = f.select("file", F.posexplode("misses").alias("i", "m")).select(F.concat(F.lit("1 "), F.col("file"), F.format_string(" %04d", "i")).alias("at"), F.concat(F.lit("- " if markdown else "  "), "m").alias("line"))
    return head.union(files).union(misses)


def gate(checks: DataFrame, least: float) -> DataFrame:
    """(pct, passed): whether the share of checks that hold reaches the least percentage; nothing to check fails."""
    c = checks.agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))
    pct = percent(F.col("hits"), F.col("total"))
    return c.select(pct.alias("pct"), F.coalesce(pct >= least, F.lit(False)).alias("passed"))


#: What is said without any reading, the bounds of a confidence, and what each further reading adds.
NO_READING, LEAST_SURE, MOST_SURE, EACH_MORE, MOST_MORE = 0.30, 0.25, 0.92, 0.025, 0.08


def consensus(observations: DataFrame, key: str) -> DataFrame:
    """(key, value, confidence): of readings (key, value, score, source) the value with the best evidence.

    Values are ranked by their best score, more for each further reading, for a second source and for single cells; ties go
    to more readings, then the better one, then the smaller value. How sure that is doesn't depend on the sources: the best
    score and a little for each further reading. Readings without a value or score don't count; a key with no others is 0.
    """
    d = observations.withColumn("value", F.when(F.col("score").isNotNull(), F.col("value")))
    d = d.groupBy(key, "value").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.bool_or(F.col("source") == "cells").alias("cells"))
    more = F.least(F.lit(0.15), 0.05 * (F.col("n") - 1)) + F.when(F.col("sources") > 1, 0.04).otherwise(0.0) + F.when(F.coalesce("cells", F.lit(False)), 0.06).otherwise(0.0)
    sure = F.col("best") + F.least(F.lit(MOST_MORE), EACH_MORE * (F.col("n") - 1))
    d = d.withColumns({"rank": F.col("best") + more, "confidence": F.greatest(F.lit(LEAST_SURE), F.least(F.lit(MOST_SURE), sure))})
    order = F.struct(F.round("rank", 9).alias("r"), "n", "best", (-F.col("value")).alias("v"), "value", "confidence")
    best = d.groupBy(key).agg(F.max(F.when(F.col("value").isNotNull(), order)).alias("x"))
    return best.select(key, F.coalesce("x.value", F.lit(0)).alias("value"), F.coalesce("x.confidence", F.lit(NO_READING)).alias("confidence"))


#: Scores over which two digits come first, and over which one and two digits are taken without a hint.
TWO_DIGITS, ONE_ALONE = 0.32, 0.80


def cell_token(readings: DataFrame, key: str) -> DataFrame:
    """(key, digits, score) of a cell's readings (key, digits string, score, hint boolean): two digits first if one of their
    readings is fair, then what was read most often, then the better mean, then the better best, then the smaller.

    What isn't one or two digits doesn't count. Without a hint it is taken only if its best score is high enough, two digits
    more easily than one; else digits and score are null.
    """
    d = readings.where(F.col("digits").rlike("^[0-9]{1,2}$") & F.col("score").isNotNull())
    d = d.groupBy(key, "digits").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("best"), F.bool_or(F.coalesce("hint", F.lit(False))).alias("hint"))
    two = F.length("digits") == 2
    order = F.struct((two & (F.col("best") >= TWO_DIGITS)).alias("two"), "n", F.round("mean", 9).alias("m"), F.col("best").alias("b"), (-F.col("digits").cast("int")).alias("v"), "digits", "best", "hint")
    d = d.groupBy(key).agg(F.max(order).alias("x"), F.bool_or("hint").alias("hint"))
    fine = F.col("hint") | (F.col("x.best") >= F.when(F.length("x.digits") == 2, TWO_DIGITS).otherwise(ONE_ALONE))
    return d.select(key, F.when(fine, F.col("x.digits")).alias("digits"), F.when(fine, F.col("x.best")).alias("score"))
