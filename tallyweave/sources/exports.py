"""Exports: a summary and a detailed listing of slips, nested documents, certificate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The summary's headers and the columns below them.
SUMMARY = {
    "Slip ID": "id", "Reference": "slip_reference", "Ballot Type": "ballot_type", "Election": "election_name", "Province": "province", "Municipality": "municipality", "Voting District": "voting_district",
    "Station Name": "station_name", "Registered Voters": "registered_voters", "Status": "status", "Valid Votes": "total_valid_votes", "Spoilt Votes": "total_spoilt_votes", "Total Votes Cast": "total_votes_cast",
    "Special Votes": "special_votes", "Pages Expected": "total_expected_pages", "Pages Received": "total_received_pages", "Approved By": "approved_by", "Approved At": "approved_at",
    "Processing Started At": "processing_started_at", "Processing Ended At": "processing_ended_at", "Uploaded At": "created_at",
}
#: The lines before a detailed listing.
PREAMBLE = {"Slip ID": "id", "Slip Reference": "slip_reference", "Ballot Type": "ballot_type", "Voting District": "voting_district", "Station Name": "station_name", "Total Valid Votes": "total_valid_votes", "Total Votes Cast": "total_votes_cast"}
DETAIL = ("Page", "Row Index", "Party Name", "Party Code", "Votes", "Confidence Score", "Manual Override", "Agent Signature Detected")


def summary(slips: DataFrame, status: str | None = None) -> DataFrame:
    """The 21 columns of every slip, newest first (ties by id); what is missing is an empty text."""
    d = slips.where(F.col("status") == status) if status else slips
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in slips.columns else F.lit("")
    return d.orderBy(F.desc("created_at"), "id").select(*[text(c).alias(k) for k, c in SUMMARY.items()])


def yes_no(c: Column) -> Column:
    return F.when(c, "YES").otherwise("NO")


def with_page(party: DataFrame, pages: DataFrame) -> DataFrame:
    return party.join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id")


def quoted(c: Column) -> Column:
    """A value as a CSV field."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def detailed(slips: DataFrame, pages: DataFrame, party: DataFrame) -> DataFrame:
    """(slip_id, at, line): the lines of each slip's detailed listing, in order of `at`: seven preamble lines under a
    title, an empty one, headers, then the party rows by page and row."""
    line = lambda *cs: F.concat_ws(",", *cs)
    head = [F.lit("# ELECTION RESULT SLIP DETAILED EXPORT"), *[line(F.lit(k), quoted(F.col(c))) for k, c in PREAMBLE.items()], F.lit(""), F.lit(",".join(DETAIL))]
    top = slips.select(F.col("id").alias("slip_id"), F.posexplode(F.array(*head)).alias("i", "line")).select("slip_id", F.format_string("0 %04d", "i").alias("at"), "line")
    d = with_page(party, pages)
    row = line(F.col("page_number").cast("string"), (F.col("row_index") + 1).cast("string"), quoted(F.col("party_name")), quoted(F.col("party_code")), F.col("votes").cast("string"), F.format_string("%.2f", "confidence_score"), yes_no(F.col("is_overridden")), yes_no(F.col("signature_detected")))
    return top.union(d.select("slip_id", F.format_string("1 %09d %09d ", "page_number", "row_index"), row).toDF("slip_id", "at", "line"))


def envelope(slips: DataFrame, exported_at: str, status: str | None = None) -> DataFrame:
    """(part, json): the summary as JSON lines: first count and time, then a slip a line, nulls kept. A line a slip, as one
    value of all slips would have to fit a task."""
    d = slips.where(F.col("status") == status) if status else slips
    keep = {"ignoreNullFields": "false"}
    head = d.agg(F.count("*").alias("count")).select(F.lit("").alias("part"), F.to_json(F.struct("count", F.lit(exported_at).alias("exported_at")), keep).alias("json"))
    return head.union(d.select(F.concat(F.lit("slip "), "id"), F.to_json(F.struct(*[d[c] for c in d.columns]), keep)))


def documents(slips: DataFrame, pages: DataFrame, party: DataFrame, results: DataFrame, audit: DataFrame, together: bool = False) -> DataFrame:
    """(slip_id, doc): each slip with its pages, party rows, rule results and audit rows (oldest first), as a struct for
    to_json. Children are gathered a slip at a time: their number is bounded by the slip's pages and edits.

    `together`: every party row is of the same slip as its page. Then its page is sought among the slip's own, and no
    party row is shuffled by page."""
    sort = lambda found, order: F.sort_array(found) if order else found
    gather = lambda d, key, order, name: d.groupBy(F.col(key).alias("slip_id")).agg(sort(F.collect_list(F.struct(*order, *[c for c in d.columns if c not in order])), order).alias(name))
    out = slips.select(F.col("id").alias("slip_id"), F.struct(*[slips[c] for c in slips.columns]).alias("slip"))
    by = ["page_number", "row_index", "id"]
    rows = gather(party, "slip_id", [], "party_results") if together else gather(with_page(party, pages), "slip_id", by, "party_results")
    parts = [("pages", gather(pages, "slip_id", ["page_number", "id"], "pages")), ("party_results", rows), ("validation_results", gather(results, "id", ["rule_code"], "validation_results")), ("audit_trail", gather(audit, "slip_id", ["timestamp", "id"], "audit_trail"))]
    for name, d in parts:
        out = out.join(d, "slip_id", "left").withColumn(name, F.coalesce(name, F.array()))
    if together:
        names = [*by, "page_id", *[c for c in party.columns if c not in (*by, "page_id")]]
        placed = lambda r: F.transform(F.filter("pages", lambda p: p["id"] == r["page_id"]), lambda p: F.struct(*[(p if c == "page_number" else r)[c].alias(c) for c in names]))
        out = out.withColumn("party_results", F.sort_array(F.flatten(F.transform("party_results", placed))))
    return out.select("slip_id", F.struct("slip", *[name for name, _ in parts]).alias("doc"))


def certificate(slips: DataFrame, pages: DataFrame, party: DataFrame) -> DataFrame:
    """(slip_id, page_number, row, name, code, votes, confidence): the rows of a printed certificate of complete slips;
    names end after 35 characters, confidence is a whole percentage."""
    ready = slips.where("status <> 'incomplete' AND total_received_pages >= total_expected_pages").select(F.col("id").alias("slip_id"))
    d = with_page(party, pages).join(ready, "slip_id")
    return d.select("slip_id", "page_number", (F.col("row_index") + 1).alias("row"), F.substring("party_name", 1, 35).alias("name"), F.col("party_code").alias("code"), "votes", F.concat(F.bround(100 * F.col("confidence_score")).cast("int").cast("string"), F.lit("%")).alias("confidence"))
