"""Edits of slips, pages, party rows and rules as events: an append-only log of commands, folded into the tables' state.

A command is a row (seq, action, slip_id, page_id, party_id, user_id, field, value, reason, at). Tables are never changed in
place; each function below gives a table's state after a log, from one pass over the log grouped by the table's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a slip that a reviewer may edit.
EDITABLE = ("station_name", "municipality", "province", "registered_voters", "total_valid_votes", "total_spoilt_votes", "total_votes_cast", "special_votes", "section_24a_votes", "presiding_officer_name")
#: What is written where no reason is given.
REASONS = {"edit_slip_field": "Manual correction via review workspace", "reject_slip": "Rejected by operator", "flag_slip": "Flagged for review"}
COMMANDS = "seq bigint, action string, slip_id string, page_id string, party_id string, user_id string, field string, value string, reason string, at timestamp"


def _last(action: str | list[str], value: Column, *more: Column) -> Column:
    """The value of the last command of an action, by seq."""
    hit = F.col("action").isin(action if isinstance(action, list) else [action])
    for m in more:
        hit &= m
    return F.max_by(value, F.when(hit, F.col("seq")))


def valid(commands: DataFrame) -> DataFrame:
    """Commands that may act: edits of editable fields only, and links and unlinks with a reason of at least 5 characters."""
    fine = ~F.col("action").isin("edit_slip_field") | F.col("field").isin(*EDITABLE)
    fine &= ~F.col("action").isin("manual_link_page", "manual_unlink_page") | (F.length(F.trim(F.coalesce("reason", F.lit("")))) >= 5)
    return commands.where(fine)


def edited_slips(slips: DataFrame, commands: DataFrame) -> DataFrame:
    """Slips after edits of fields, rejections, flags, approvals, deletions and a clearing of all.

    The last edit of each field counts whose value can be cast to the field's type; the last of reject, flag and approve
    makes the status. A slip is gone if the last deletion or clearing came after it was last created again. Commands are
    taken as they are; replay.py does them one by one and says which are refused.
    """
    c = valid(commands)
    cleared = c.where("action = 'clear_all_slips'").agg(F.max("seq").alias("__cleared"))  # one row
    own = [f for f in EDITABLE if f in slips.columns]
    status = F.when(F.col("action") == "reject_slip", "rejected").when(F.col("action") == "flag_slip", "flagged").otherwise("approved")
    last = c.where("slip_id IS NOT NULL").groupBy(F.col("slip_id").alias("id")).agg(
        *[_last("edit_slip_field", F.struct("value"), F.col("field") == f, F.col("value").isNull() | F.expr(f"try_cast(value AS {slips.schema[f].dataType.simpleString()})").isNotNull()).alias(f"__{f}") for f in own],
        _last(["reject_slip", "flag_slip", "approve_slip"], F.struct(status.alias("status"), "reason", "action", "user_id", "at")).alias("__status"),
        F.max(F.when(F.col("action") == "delete_slip", F.col("seq"))).alias("__gone"),
        F.max(F.when(F.col("action") == "create_slip", F.col("seq"))).alias("__made"),
        F.max("at").alias("__at"),
    )
    d = slips.join(last, "id", "left").crossJoin(F.broadcast(cleared))
    gone = F.greatest("__gone", "__cleared")
    d = d.where(gone.isNull() | (F.coalesce("__made", F.lit(-1)) > gone))
    new = {f: F.when(F.col(f"__{f}").isNotNull(), F.expr(f"try_cast(__{f}.value AS {slips.schema[f].dataType.simpleString()})")).otherwise(F.col(f)) for f in own}
    new["status"] = F.coalesce("__status.status", "status")
    why = F.coalesce("__status.reason", F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("__status.action")))
    extra = {"rejection_reason": F.when(F.col("__status.status") == "rejected", why), "approved_by": F.when(F.col("__status.status") == "approved", F.col("__status.user_id")), "approved_at": F.when(F.col("__status.status") == "approved", F.col("__status.at"))}
    new |= {k: F.coalesce(v, F.col(k)) if k in slips.columns else v for k, v in extra.items()}
    return d.withColumns(new).select(*dict.fromkeys([*slips.columns, *extra]))


def overridden_party(party: DataFrame, commands: DataFrame) -> DataFrame:
    """Party rows after votes were corrected: never below 0, marked as overridden, what was read kept beside. A correction
    that is no whole number leaves the row alone."""
    last = commands.where("action = 'override_party_votes' AND try_cast(value AS INT) IS NOT NULL").groupBy(F.col("party_id").alias("id")).agg(F.max_by(F.struct("value", "user_id"), "seq").alias("__v"))
    d = party.join(last, "id", "left")
    has = F.col("__v").isNotNull()
    read = F.coalesce("original_ocr_votes", "votes") if "original_ocr_votes" in party.columns else F.col("votes")
    new = {"original_ocr_votes": read, "votes": F.when(has, F.greatest(F.lit(0), F.expr("try_cast(__v.value AS INT)"))).otherwise(F.col("votes")), "is_overridden": has | F.col("is_overridden"), "overridden_by": F.when(has, F.col("__v.user_id"))}
    return d.withColumns(new).select(*dict.fromkeys([*party.columns, *new]))


def linked_pages(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """Pages after links, unlinks and removals: the last link names the slip, an unlink a slip of the page's own, and a
    removed page, or one whose slip was deleted or all cleared, is gone."""
    c = valid(commands)
    own = F.concat("slip_id", F.lit("_unlinked_"), F.substring(F.sha2(F.concat_ws("|", "page_id", F.col("seq").cast("string")), 256), 1, 4))
    target = F.when(F.col("action") == "manual_link_page", F.col("value")).otherwise(own)
    moved = c.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("id")).agg(_last(["manual_link_page", "manual_unlink_page"], target).alias("__slip"), F.max(F.when(F.col("action") == "remove_page", F.col("seq"))).alias("__gone"))
    d = pages.join(moved, "id", "left").where("__gone IS NULL").withColumn("slip_id", F.coalesce("__slip", "slip_id")).select(pages.columns)
    dead = c.where("action = 'delete_slip'").select("slip_id").distinct()
    cleared = c.where("action = 'clear_all_slips'").limit(1).select(F.lit(True).alias("__c"))  # one row at most
    return d.join(dead, "slip_id", "left_anti").join(F.broadcast(cleared), F.lit(True), "left_anti").select(pages.columns)


def following(children: DataFrame, pages: DataFrame) -> DataFrame:
    """Party rows of pages that are left, under the slip the page belongs to now."""
    return children.drop("slip_id").join(pages.select(F.col("id").alias("page_id"), "slip_id"), "page_id").select(children.columns)


def latest_pages(versions: DataFrame) -> DataFrame:
    """The last version of each page (id, version, ...): a replacement overwrites the page as a whole."""
    rest = [c for c in versions.columns if c != "id"]
    return versions.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("id", "v.*").select(versions.columns)


def replaced_scalars(slips: DataFrame, replacements: DataFrame, fields: list[str]) -> DataFrame:
    """Slips after pages were replaced: of each field the last value that says something (not NULL, empty, 0 or unknown)."""
    says = lambda f: F.col(f).isNotNull() & ~F.lower(F.col(f).cast("string")).isin("", "0", "unknown")
    last = replacements.groupBy(F.col("slip_id").alias("id")).agg(*[F.max_by(f, F.when(says(f), F.col("seq"))).alias(f"__{f}") for f in fields])
    return slips.join(last, "id", "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(slips.columns)


def merged_scalars(records: DataFrame, first: list[str], final: list[str]) -> DataFrame:
    """Slips from arriving page records (slip_id, seq, page_number, page_total, ...): of `first` fields the first value that
    says something, the largest page total, and `final` fields from the last final page."""
    says = lambda f: F.col(f).isNotNull() & ~F.col(f).cast("string").isin("", "0")
    on_final = F.col("page_number") == F.col("page_total")
    return records.groupBy("slip_id").agg(*[F.min_by(f, F.when(says(f), F.col("seq"))).alias(f) for f in first], F.max("page_total").alias("total_expected_pages"), *[F.max_by(f, F.when(on_final, F.col("seq"))).alias(f) for f in final])


def mismatch_flags(records: DataFrame) -> DataFrame:
    """(slip_id, seq, flags): pages whose district or type differs from those of the slip's first page."""
    w = Window.partitionBy("slip_id").orderBy("seq")
    d = records.withColumns({"vd0": F.first("voting_district").over(w), "type0": F.first("ballot_type").over(w)})
    vd = F.when(F.col("vd0") != F.col("voting_district"), F.concat(F.lit("MISMATCHED_VD: Existing VD "), "vd0", F.lit(" != incoming VD "), "voting_district", F.lit(".")))
    kind = F.when(F.col("type0") != F.col("ballot_type"), F.concat(F.lit("MISMATCHED_BALLOT_TYPE: Existing "), "type0", F.lit(" != incoming "), "ballot_type", F.lit(".")))
    return d.select("slip_id", "seq", F.array_compact(F.array(vd, kind)).alias("flags"))


def processing_windows(slips: DataFrame, batches: DataFrame) -> DataFrame:
    """Slips with the window of the last batch (slip_id, started_at, ended_at, seq) that touched them."""
    last = batches.groupBy(F.col("slip_id").alias("id")).agg(F.max_by(F.struct("started_at", "ended_at"), "seq").alias("w"))
    return slips.join(last, "id", "left").withColumns({"processing_started_at": F.col("w.started_at"), "processing_ended_at": F.col("w.ended_at")}).drop("w")


def audit_of(commands: DataFrame, slips: DataFrame) -> DataFrame:
    """The audit rows of a log: each command with the value that its field had before, from the log or the slip.

    Values are text; the row of a deletion names no slip, and a clearing of all leaves none.
    """
    c = valid(commands).where("action <> 'clear_all_slips'")
    before = F.last(F.col("value"), ignorenulls=True).over(Window.partitionBy("slip_id", "page_id", "party_id", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    own = [f for f in EDITABLE if f in slips.columns]
    now = slips.select(F.col("id").alias("slip_id"), F.create_map(*[x for f in own for x in (F.lit(f), F.col(f).cast("string"))]).alias("__now"))
    d = c.withColumn("old_value", before).join(now, "slip_id", "left")
    d = d.withColumn("old_value", F.coalesce("old_value", F.when(F.col("action") == "edit_slip_field", F.try_element_at("__now", F.col("field")))))
    why = F.coalesce("reason", F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("action")))
    gone = F.col("action") == "delete_slip"
    return d.select(F.concat(F.lit("aud_"), F.col("seq").cast("string")).alias("id"), F.when(~gone, F.col("slip_id")).alias("slip_id"), "page_id", "user_id", "action", F.col("field").alias("field_name"), "old_value", F.col("value").alias("new_value"), why.alias("reason"), F.col("at").alias("timestamp"))


def updated_rules(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """Rules after partial updates (rule_code, seq, fields): the last value given for each field; in order of code."""
    fields = [c for c in rules.columns if c != "rule_code"]
    last = updates.groupBy("rule_code").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"__{f}") for f in fields])
    d = rules.join(last, "rule_code", "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(rules.columns)
    return d.orderBy("rule_code")


def seeded(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The table with those seed rows whose key it lacks."""
    return table.unionByName(seed.join(table.select(key), key, "left_anti").select(table.columns))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
