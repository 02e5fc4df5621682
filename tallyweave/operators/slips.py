"""Set-based operators over slips, pages, party rows, rules and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.schemas import RULE_SEED, RULES


def consolidate(slips: DataFrame, pages: DataFrame, party: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slips with received pages, missing pages and status; votes by slip and party code).

    Votes of a page that came twice add up; name, confidence and signature are those of the first row by page and row.
    A missing page makes a slip incomplete, else a flagged page makes it flagged, else an approved one stays approved.
    """
    got = pages.groupBy(F.col("slip_id").alias("id")).agg(
        F.sort_array(F.collect_set("page_number")).alias("received"),
        F.bool_or(F.size(F.coalesce("exception_flags", F.array())) > 0).alias("odd"),
        F.bool_or(~F.array_contains(F.coalesce("exception_flags", F.array()), "not_a_result_slip")).alias("is_vote_related"),
    )
    want = F.when(F.col("total_expected_pages") >= 1, F.sequence(F.lit(1), "total_expected_pages")).otherwise(F.array().cast("array<int>"))
    out = slips.drop("is_vote_related").join(got, "id", "left").withColumns({"received": F.coalesce("received", F.array().cast("array<int>")), "is_vote_related": F.coalesce("is_vote_related", F.lit(False))})
    out = out.withColumn("missing", F.array_except(want, "received")).withColumn("total_received_pages", F.size("received"))
    status = F.when(F.size("missing") > 0, "incomplete").when(F.coalesce("odd", F.lit(False)), "flagged").when(F.col("status") == "approved", "approved").otherwise("pending_review")
    place = party.join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id")
    first = F.struct("page_number", "row_index")
    votes = place.groupBy("slip_id", "party_code").agg(F.sum("votes").alias("votes"), *[F.min_by(c, first).alias(c) for c in ("party_name", "confidence_score", "signature_detected")])
    return out.withColumn("status", status).drop("odd"), votes


def rules_frame(spark) -> DataFrame:
    return spark.createDataFrame(RULE_SEED, RULES)


def slip_metrics(slips: DataFrame, pages: DataFrame, party: DataFrame) -> DataFrame:
    """One row a slip: what the rules look at. Slips that come from consolidate hold their pages (`received`); those of
    others are gathered here. Twins are told by a window over the slips themselves, so that they are read once."""
    slips = slips.drop("missing")
    if "received" in slips.columns:
        d = slips.withColumnRenamed("received", "got")
    else:
        d = slips.join(pages.groupBy(F.col("slip_id").alias("id")).agg(F.sort_array(F.collect_set("page_number")).alias("got")), "id", "left")
    codes = F.slice(F.sort_array(F.collect_list(F.when((F.col("votes") > 0) & ~F.col("signature_detected"), F.struct("row_index", "party_code")))), 1, 5)
    low = F.count_if(low_confidence()) if {"is_overridden", "confidence_score"} <= set(party.columns) else F.lit(0)
    sums = party.groupBy(F.col("slip_id").alias("id")).agg(F.sum("votes").alias("sum_party"), F.transform(codes, lambda x: x["party_code"]).alias("unsigned"), low.alias("low"))
    d = d.join(sums, "id", "left")
    approved = F.when(F.col("status") == "approved", F.col("id"))
    kin = Window.partitionBy("voting_district", "ballot_type")
    d = d.withColumns({"lo": F.min(approved).over(kin), "hi": F.max(approved).over(kin)})
    d = d.withColumns({"got": F.coalesce("got", F.array().cast("array<int>")), "sum_party": F.coalesce("sum_party", F.lit(0)), "low": F.coalesce("low", F.lit(0)), "reg": F.greatest(F.coalesce("registered_voters", F.lit(0)), F.lit(1)), "exp": F.col("total_expected_pages"), "valid": F.coalesce("total_valid_votes", F.lit(0)), "spoilt": F.coalesce("total_spoilt_votes", F.lit(0)), "cast": F.coalesce("total_votes_cast", F.lit(0))})
    want = F.when(F.col("exp") >= 1, F.sequence(F.lit(1), "exp")).otherwise(F.array().cast("array<int>"))
    twin = F.col("voting_district").isNotNull() & F.col("ballot_type").isNotNull() & ((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")))
    return d.withColumns({"final": F.array_contains("got", F.col("exp")), "missing": F.array_except(want, "got"), "twin": F.coalesce(twin, F.lit(False)), "unsigned": F.coalesce("unsigned", F.array().cast("array<string>"))})


def _verdict(r: str = "") -> str:
    """The result of a rule, whose columns have the prefix r, for a row of metrics; unknown rules pass."""
    sev = f"IF({r}severity = 'error', 'fail', 'warn')"
    return f"""CASE {r}rule_code
      WHEN 'SUM_PARTY_VOTES_MATCH' THEN CASE WHEN final AND valid > 0 THEN IF(abs(sum_party - valid) > coalesce({r}tolerance, 0), {sev}, 'pass') WHEN size(got) < exp THEN 'warn' ELSE 'pass' END
      WHEN 'RECONCILIATION_MATCH' THEN IF(final AND (valid > 0 OR cast > 0) AND valid + spoilt <> cast, {sev}, 'pass')
      WHEN 'TURNOUT_CEILING' THEN CASE WHEN sum_party > reg THEN 'fail' WHEN cast > 0 AND (100D * cast / reg > coalesce({r}max_pct, 100) OR cast > reg) THEN 'fail'
        WHEN 100D * IF(cast > 0, cast, sum_party) / reg > coalesce({r}warning_pct, 90) THEN 'warn' ELSE 'pass' END
      WHEN 'VOTES_WITHIN_REGISTERED' THEN IF(sum_party > reg OR cast > reg, {sev}, 'pass')
      WHEN 'ALL_PAGES_PRESENT' THEN IF(size(missing) > 0, 'fail', 'pass')
      WHEN 'OFFICER_SIGNATURE_PRESENT' THEN IF(final AND NOT presiding_officer_signature_detected, 'warn', 'pass')
      WHEN 'DUPLICATE_VD_BALLOT' THEN IF(twin, 'fail', 'pass')
      WHEN 'PARTY_SIGNATURE_CONSISTENCY' THEN IF(size(unsigned) > 0, 'warn', 'pass') ELSE 'pass' END"""


def evaluate_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_code, result) for each slip that is about votes and each active rule; unknown rules pass."""
    # Rules are few. Without the hint Spark pairs every part of the slips with every part of the rules.
    return metrics.where("is_vote_related").crossJoin(F.broadcast(rules.where("is_active"))).select("id", "rule_code", F.expr(_verdict()).alias("result"))


def judged(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics with has_errors and has_warnings, whether a rule of evaluate_rules fails or warns: row by row, without a
    shuffle of the results. Both are null for slips that aren't about votes."""
    whole = rules.where("is_active").agg(F.collect_list(F.struct("rule_code", "severity", "tolerance", "warning_pct", "max_pct")).alias("__rules"))
    d = metrics.crossJoin(F.broadcast(whole)).withColumn("__v", F.when(F.col("is_vote_related"), F.expr(f"transform(__rules, r -> {_verdict('r.')})")))
    return d.withColumns({"has_errors": F.array_contains("__v", "fail"), "has_warnings": F.array_contains("__v", "warn")}).drop("__rules", "__v")


def _flagged(slips: DataFrame, results: DataFrame | None) -> DataFrame:
    """slips with has_errors and has_warnings of the results; without results they come from judged."""
    if results is None:
        return slips
    flags = results.groupBy("id").agg(F.bool_or(F.col("result") == "fail").alias("has_errors"), F.bool_or(F.col("result") == "warn").alias("has_warnings"))
    return slips.join(flags, "id", "left")


def eligibility(slips: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(id, eligible, has_warning): no rule failed and no page is missing; slips that aren't about votes are never
    eligible and always warn."""
    d = _flagged(slips, results)
    fine = F.col("is_vote_related") & ~F.coalesce("has_errors", F.lit(False)) & (F.col("status") != "incomplete")
    return d.select("id", fine.alias("eligible"), (~F.col("is_vote_related") | F.coalesce("has_warnings", F.lit(False))).alias("has_warning"))


def may_approve(slips: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(id, enabled): flags are (id, has_errors, unchecked), or columns of slips: a reviewer may approve what is about
    votes, whole, without errors and with every doubtful row checked."""
    d = slips if flags is None else slips.join(flags, "id", "left")
    fine = F.col("is_vote_related") & (F.col("status") != "incomplete") & ~F.coalesce("has_errors", F.lit(False)) & (F.coalesce("unchecked", F.lit(0)) == 0)
    return d.select("id", fine.alias("enabled"))


def dashboard(slips: DataFrame) -> DataFrame:
    """One row: slips in all and by status."""
    return slips.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("approved", "approved"), ("pending_review", "pending"), ("incomplete", "incomplete"), ("flagged", "flagged"))])


def upload_summary(uploads: DataFrame) -> DataFrame:
    """(slip_id, ...) of upload answers (slip_id, seq, page_total, pages array<int>, missing array<int>, status,
    barcode_text): the largest total, all pages, the last answer's missing pages and status, the last barcode that is
    there, and the page to take next."""
    last = lambda c: F.max_by(c, "seq")
    d = uploads.groupBy("slip_id").agg(F.max("page_total").alias("expected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("received"), last("missing").alias("missing"), last("status").alias("status"), F.max_by("barcode_text", F.when(F.coalesce("barcode_text", F.lit("")) != "", F.col("seq"))).alias("barcode_text"))
    return d.withColumn("next_page", F.get("missing", F.lit(0)))


def approval(metrics: DataFrame, results: DataFrame | None = None, party: DataFrame | None = None) -> DataFrame:
    """(id, decision): approved, or the first gate that blocks. Without results metrics are judged ones, and without party
    rows their own number of doubtful rows counts."""
    d = _flagged(metrics, results)
    if party is not None:
        d = d.drop("low").join(party.groupBy(F.col("slip_id").alias("id")).agg(F.count_if(low_confidence()).alias("low")), "id", "left")
    gate = F.when(~F.col("is_vote_related"), "not_vote_related").when((F.size("missing") > 0) | (F.col("status") == "incomplete"), "incomplete").when(F.coalesce("has_errors", F.lit(False)), "rule_failed").when(F.coalesce("low", F.lit(0)) > 0, "low_confidence").otherwise("approved")
    return d.select("id", gate.alias("decision"))


def low_confidence() -> Column:
    return F.expr("NOT is_overridden AND ((votes > 0 AND confidence_score < 0.72D) OR confidence_score < 0.4D)")


def vote_related() -> Column:
    return F.expr("coalesce(is_vote_related, true) AND NOT (upper(coalesce(voting_district, '')) = 'UNKNOWN' AND startswith(slip_reference, 'UNREAD'))")


def list_slips(slips: DataFrame, results: DataFrame | None = None, status: str | None = None, ballot_type: str | None = None, district: str | None = None, search: str | None = None) -> DataFrame:
    """Filtered slips, newest first, with has_errors and has_warnings; slips that aren't about votes show zeros. Without results slips are judged ones."""
    d = slips
    for name, value in (("status", status), ("ballot_type", ballot_type), ("voting_district", district)):
        d = d.where(F.col(name) == value) if value else d
    if search:
        hit = F.lit(False)
        for name in ("slip_reference", "voting_district", "station_name", "municipality"):
            hit |= F.coalesce(F.col(name).ilike(f"%{search}%"), F.lit(False))
        d = d.where(hit)
    d = _flagged(d, results).withColumn("vote_related", vote_related())
    d = d.withColumns({c: F.when(F.col("vote_related"), F.col(c)).otherwise(0) for c in ("total_valid_votes", "total_spoilt_votes", "total_votes_cast", "registered_voters")})
    return d.withColumns({"has_errors": F.coalesce("has_errors", F.lit(False)), "has_warnings": F.coalesce("has_warnings", ~F.col("vote_related"))}).orderBy(F.desc("created_at"), "id")


def fold_commands(state: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Applies an append-only log (key, seq, field, value) to rows: the latest value of each field wins; a `deleted` row
    is gone unless a later `created` one brings it back. What can't be cast to the field's type is NULL."""
    fields = [c for c in state.columns if c != key]
    at = lambda name: F.max(F.when(F.col("field") == name, F.col("seq")))
    last = log.groupBy(key).agg(*[F.max_by(F.struct("value"), F.when(F.col("field") == c, F.col("seq"))).alias(f"__{c}") for c in fields], at("deleted").alias("__gone"), at("created").alias("__made"))
    d = state.join(last, key, "left").where(F.col("__gone").isNull() | F.coalesce(F.col("__made") > F.col("__gone"), F.lit(False)))
    new = lambda c: F.expr(f"try_cast(`__{c}`.value AS {state.schema[c].dataType.simpleString()})")
    return d.select(key, *[F.when(F.col(f"__{c}").isNotNull(), new(c)).otherwise(F.col(c)).alias(c) for c in fields])


def audit_page(log: DataFrame, users: DataFrame, slips: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the audit log, newest first, with user and slip."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset at least 0")
    d = log.join(users.select(F.col("id").alias("user_id"), F.col("username").alias("user_name"), F.col("role").alias("user_role")), "user_id", "left")
    d = d.join(slips.select(F.col("id").alias("slip_id"), "slip_reference", "ballot_type"), "slip_id", "left")
    return d.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def score(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Gold and predicted votes side by side: an absent expectation is 0, an absent prediction is a miss."""
    d = gold.withColumnRenamed("votes", "expected").join(predicted.withColumnRenamed("votes", "actual"), keys, "full_outer")
    return d.select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), "actual", F.coalesce("expected", F.lit(0)).eqNullSafe(F.col("actual")).alias("ok"))


def integrity(slips: DataFrame, pages: DataFrame, party: DataFrame) -> DataFrame:
    """(check, key) of each violation, from one pass over each table and the joins that need another."""

    def say(d: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
        return d.select(F.explode(hits).alias("check"), F.col(key).cast("string").alias("key"))

    c, ids = F.col, slips.select(F.col("id").alias("slip_id"), F.lit(True).alias("__known"))
    out = say(pages.join(ids, "slip_id", "left"), "id", {"orphan_page": c("__known").isNull(), "page_number": c("page_number") < 1})
    out = out.union(say(party.join(ids, "slip_id", "left"), "id", {"orphan_party_row": c("__known").isNull(), "negative": (c("votes") < 0) | (c("confidence_score") < 0)}))
    of_slip = {"status": ~c("status").isin("incomplete", "pending_review", "approved", "rejected", "flagged"), "approved_incomplete": (c("status") == "approved") & (c("total_received_pages") < c("total_expected_pages"))}
    out = out.union(say(slips, "id", of_slip))
    twice = pages.groupBy("slip_id", "page_number").count().where("count > 1")
    out = out.union(twice.select(F.lit("page_twice"), c("slip_id").cast("string")))
    twins = slips.where("status = 'approved'").groupBy("voting_district", "ballot_type").agg(F.count("*").alias("n")).where("n > 1")
    return out.union(twins.select(F.lit("approved_twins"), F.concat_ws("|", "voting_district", "ballot_type")))


def nearest_row(df: DataFrame, keys: list[str], at: str, target: str) -> DataFrame:
    """The row nearest to its target within each key; ties to the smaller place."""
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(at) - F.col(target)), at)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
