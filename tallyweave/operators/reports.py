"""Accuracy reports as ordered text: every line a row with the place it has, written in order by many tasks.

A place is (section, file, part, i): sections follow each other, within them the files by name, within a file its parts and
their lines. Nothing is gathered but what belongs to one file, and no task holds the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.scoring import counters, percent, shown

#: Fields of a page that a report shows of what was read, in order.
SNAPSHOT = ("ballot_type", "page_number", "page_total", "voting_district", "barcode_text", "province", "municipality", "station_name", "officer", "registered_voters", "total_valid_votes", "total_spoilt_votes", "total_votes_cast", "special_votes", "section_24a_votes")
#: Fixed values in the functions below: headings, labels, column widths and rules of the report's text.
LINE = "section int, file string, part int, i int, line string"
_ORDER = ("section", "file", "part", "i")


def snapshot(records: DataFrame) -> DataFrame:
    """Of page records the fields that a report shows, `exception_flags` (never null) and `parties`, an array of what was
    read of each row; fields that records lack are null."""
    has = set(records.columns)
    fields = [F.col(f).alias(f) if f in has else F.lit(None).cast("string").alias(f) for f in SNAPSHOT]
    row = lambda r: F.struct(r["party_code"].alias("code"), r["party_name"].alias("name"), r["votes"].alias("votes"), r["confidence_score"].alias("confidence"))
    party = F.coalesce(F.transform("party_results", row), F.array()) if "party_results" in has else F.array()
    flags = F.coalesce("exception_flags", F.array().cast("array<string>")) if "exception_flags" in has else F.array().cast("array<string>")
    return records.select("file", *fields, flags.alias("exception_flags"), party.alias("parties"))


def _pad(value: Column, n: int) -> Column:
    """At least n characters; longer ones stay whole."""
    return F.when(F.length(value) < n, F.rpad(value, n, " ")).otherwise(value)


def _seconds(c: str = "seconds") -> Column:
    return F.format_string("%.2fs", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))


def _put(d: DataFrame, section: int, part: int, *lines: Column | str, file: str | None = "file") -> DataFrame:
    """Rows of LINE: of each row of d these lines, null ones left out."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    name = F.col(file) if file else F.lit("")
    return d.select(F.lit(section).alias("section"), name.alias("file"), F.lit(part).alias("part"), F.posexplode(texts).alias("i", "line")).where("line IS NOT NULL")


def _each(d: DataFrame, section: int, part: int, place: Column, line: Column) -> DataFrame:
    return d.select(F.lit(section).alias("section"), "file", F.lit(part).alias("part"), place.cast("int").alias("i"), line.alias("line"))


def _share(c: DataFrame, label: str, key: str) -> Column:
    hits, total = F.col(f"{key}_hits"), F.col(f"{key}_total")
    return F.when(total > 0, F.concat(F.lit(f"{label}: "), hits.cast("string"), F.lit("/"), total.cast("string"), F.lit(" fields  ("), percent(hits, total).cast("string"), F.lit("%)")))


def text_report(pages: DataFrame, checks: DataFrame, votes: DataFrame, templates: DataFrame, head: list[str]) -> DataFrame:
    """(LINE) of the report: head, summary, misses, unlabelled files and every file, as rows in any order.

    pages: (file, seconds, error, labeled, exception_flags array) and fields of SNAPSHOT; checks: (file, field, actual,
    expected, ok); votes: (file, row_index, code, name, votes, confidence), what was read. A file with an error is neither
    scored nor shown; a vote over 0 of a code without a check is extra.
    """
    spark = pages.sparkSession
    one = spark.range(1)
    fine = pages.where("error IS NULL")
    labeled, other = fine.where("labeled"), fine.where("NOT labeled")
    checks = checks.join(labeled.select("file"), "file", "left_semi")
    known = checks.where("startswith(field, 'votes.')").select("file", F.substring("field", 7, 1 << 20).alias("code")).distinct()
    extra = votes.where("votes > 0").join(labeled.select("file"), "file", "left_semi").join(known, ["file", "code"], "left_anti")
    misses = checks.where("NOT ok")

    # Counts of the summary, one row.
    n = pages.agg(F.count("*").alias("images"), F.count_if(F.col("labeled")).alias("labeled_files"), F.count_if(~F.col("labeled")).alias("unlabeled_files"))
    c = counters(checks, templates).crossJoin(n).crossJoin(misses.agg(F.count("*").alias("n_miss"))).crossJoin(extra.agg(F.count("*").alias("n_extra"))).crossJoin(pages.agg(F.count_if(F.col("error").isNotNull()).alias("n_error")))  # each one row
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    images = text("Images: ", F.col("images"), "  labeled: ", F.col("labeled_files"), "  unlabeled: ", F.col("unlabeled_files"))
    nothing = F.when(F.col("n_miss") + F.col("n_extra") + F.col("n_error") == 0, "(none)")
    out = [
        _put(one, 0, 0, *head, "", file=None),
        _put(c, 1, 0, "=== SUMMARY ===", images, _share(c, "IEC result slips", "iec"), _share(c, "All labeled files", "labeled"), text("Misses (gold fields): ", F.col("n_miss")), text("Extra non-zero votes not in gold: ", F.col("n_extra")), "", file=None),
        _put(c, 2, 0, "=== MISSES (quick compare) ===", nothing, file=None),
        _put(one, 3, 0, "", file=None),
        _put(c.where("unlabeled_files > 0"), 4, 0, "=== UNLABELED — retrieved values (no gold to score) ===", file=None),
        _put(c.where("unlabeled_files > 0"), 5, 0, "", file=None),
        _put(one, 6, 0, "=== PER FILE ===", file=None),
    ]
    # Misses, in order of their fields, then what gold doesn't have.
    miss = text(F.col("file"), "  ", F.col("field"), ": got ", shown(F.col("actual")), "  expected ", shown(F.col("expected")))
    over = text(F.col("file"), "  votes.", F.col("code"), ": got ", F.col("votes"), "  expected 0 (not in gold)  EXTRA")
    by = lambda d, line, *cols: d.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*cols, line.alias("line")))).alias("x")).select("file", F.posexplode("x").alias("i", "r"))  # noqa: E731  of one file
    out.append(_put(pages.where("error IS NOT NULL"), 2, 1, text(F.col("file"), ": FAIL  ", F.col("error"))))
    out.append(_each(by(misses, miss, "field"), 2, 2, F.col("i"), F.col("r.line")))
    out.append(_each(by(extra, over, "row_index", "code"), 2, 3, F.col("i"), F.col("r.line")))

    # What was read of a file, with or without gold.
    shown_of = lambda f: shown(F.col(f).cast("string")) if f in pages.columns else F.lit("—")
    fields = F.array(*[text(_pad(F.lit(f), 28), " ", shown_of(f)) for f in SNAPSHOT])
    flags = F.when(F.size(F.coalesce("exception_flags", F.array())) > 0, F.array_join("exception_flags", ", "))
    conf = F.when(F.col("confidence").isNotNull(), F.format_string("  conf %.2f", F.col("confidence").cast("double"))).otherwise("")
    read = text("  ", _pad(F.coalesce("code", F.lit("")), 12), " ", F.col("votes"), conf, "  ", F.coalesce("name", F.lit("")))
    per = votes.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("votes") > 0, F.struct("row_index", read.alias("line"))))).alias("some"), F.count_if(F.coalesce("votes", F.lit(0)) == 0).alias("zeros"))
    per = per.withColumns({"some": F.transform("some", lambda r: r["line"]), "zero": F.when(F.col("zeros") == 1, "  (1 other party retrieved as 0)").when(F.col("zeros") > 1, text("  (", F.col("zeros"), " other parties retrieved as 0)"))})
    body = F.concat(F.array(F.lit(""), F.lit("Retrieved party votes:")), F.when(F.size("some") > 0, F.col("some")).otherwise(F.array(F.lit("  (all zero)"))), F.array_compact(F.array("zero")))
    per = per.select("file", body.alias("body"))
    block = lambda d, section: d.join(per, "file", "left").select(F.lit(section).alias("section"), "file", F.lit(5).alias("part"), F.posexplode(F.coalesce("body", F.array(F.lit("retrieved votes: (none)")))).alias("i", "line"))
    table = lambda d, section: [d.select(F.lit(section).alias("section"), "file", F.lit(3).alias("part"), F.posexplode(F.concat(F.array(text(_pad(F.lit("field"), 28), " retrieved")), fields)).alias("i", "line")), _put(d, section, 4, text(_pad(F.lit("exception_flags"), 28), " ", flags)), block(d, section)]
    out += [_put(other, 4, 1, "", text(F.col("file"), "  ", _seconds())), *table(other, 4)]

    score = checks.groupBy("file").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))
    d = labeled.join(score, "file", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    mark = F.when(F.col("hits") == F.col("total"), "PASS").otherwise("MISS")
    rule = "=" * 72
    out.append(_put(pages.where("error IS NOT NULL"), 6, 1, "", rule, text(F.col("file"), "  FAIL  ", F.col("error"))))
    out += [_put(other, 6, 1, "", rule, text(F.col("file"), "  unlabeled  ", _seconds())), *table(other, 6)]
    heads = text(_pad(F.lit("field"), 28), " ", _pad(F.lit("got"), 22), " ", _pad(F.lit("expected"), 22), " status")
    out.append(_put(d, 6, 1, "", rule, text(F.col("file"), "  ", mark, "  ", _seconds(), "  ", F.col("hits"), "/", F.col("total"), " gold fields"), "-" * 72, heads))
    row = text(_pad(F.col("field"), 28), " ", _pad(shown(F.col("actual")), 22), " ", _pad(shown(F.col("expected")), 22), " ", F.when(F.col("ok"), "OK").otherwise("MISS"))
    out.append(_each(by(checks, row, "field"), 6, 2, F.col("i"), F.col("r.line")))
    more = text("  ", F.coalesce("code", F.lit("")), "  ", F.coalesce("name", F.lit("")), "  got ", F.col("votes"), conf, "  EXTRA")
    out.append(_put(extra.select("file").distinct(), 6, 3, "", "Extra non-zero votes not listed in gold:"))
    out.append(_each(by(extra, more, "row_index", "code"), 6, 4, F.col("i"), F.col("r.line")))
    out += [block(labeled, 6), _put(labeled, 6, 6, text("exception_flags: ", flags)), _put(one, 7, 0, "", file=None)]
    return reduce(DataFrame.unionByName, out)


def console_lines(pages: DataFrame, checks: DataFrame) -> DataFrame:
    """(LINE) of what a console shows: a line a file, its misses below."""
    score = checks.groupBy("file").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))
    d = pages.join(score, "file", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    mark = F.when(F.col("hits") == F.col("total"), "  PASS  ").otherwise("  MISS  ")
    scored = F.concat(mark, "file", F.lit("  "), _seconds(), F.lit("  "), F.col("hits").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" fields"))
    line = F.when(F.col("error").isNotNull(), F.concat(F.lit("  FAIL  "), "file", F.lit("  ("), "error", F.lit(")"))).when(~F.col("labeled"), F.concat(F.lit("  ----  "), "file", F.lit("  "), _seconds(), F.lit("  unlabeled"))).otherwise(scored)
    shown_files = pages.where("error IS NULL AND labeled").select("file")
    miss = checks.where("NOT ok").join(shown_files, "file", "left_semi")
    told = F.concat(F.lit("        "), "field", F.lit(": got "), shown(F.col("actual")), F.lit(", expected "), shown(F.col("expected")))
    rows = miss.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("field", told.alias("line")))).alias("x")).select("file", F.posexplode("x").alias("i", "r"))
    return _put(d, 0, 0, line).unionByName(_each(rows, 0, 1, F.col("i"), F.col("r.line")))


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*_ORDER)


def write_report(lines: DataFrame, path: str, parts: int = 8) -> None:
    """The text in a folder, its part files in order: read one after another they are the report."""
    lines.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).select("line").write.mode("overwrite").text(path)
