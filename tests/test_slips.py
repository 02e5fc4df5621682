import random

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import assign, slips
from tallyweave.operators.components import components
from tallyweave.sources import files
from tallyweave.streaming import progress
from tallyweave.tables import Scratch


def slip(i, kind, reg, status, valid, spoilt, cast, exp, sig, vd="V1"):
    return (i, f"R{i}", kind, vd, reg, status, sig, valid, spoilt, cast, exp, True)


COLS = "id string, slip_reference string, ballot_type string, voting_district string, registered_voters int, status string, presiding_officer_signature_detected boolean, total_valid_votes int, total_spoilt_votes int, total_votes_cast int, total_expected_pages int, is_vote_related boolean"


def fixture(spark):
    s = spark.createDataFrame([slip("a", "Regional", 100, "pending_review", 50, 2, 52, 1, True, "V1"), slip("b", "National", 100, "pending_review", 120, 0, 120, 1, True, "V2"), slip("c", "National", 1149, "incomplete", 0, 0, 0, 3, False, "V3")], COLS)
    p = spark.createDataFrame([("pa", "a", 1, None), ("pb", "b", 1, None), ("pc", "c", 1, None)], "id string, slip_id string, page_number int, exception_flags array<string>")
    r = spark.createDataFrame([("1", "a", "pa", 0, "PA", 30), ("2", "a", "pa", 1, "PB", 20), ("3", "b", "pb", 0, "PA", 120), ("4", "c", "pc", 0, "ANC", 481), ("5", "c", "pc", 1, "EFF", 77)], "id string, slip_id string, page_id string, row_index int, party_code string, votes int")
    r = r.selectExpr("*", "party_code AS party_name", "0.95D AS confidence_score", "false AS is_overridden", "true AS signature_detected")
    return s, p, r


def test_rules_and_approval(spark):
    s, p, r = fixture(spark)
    m = slips.slip_metrics(s, p, r)
    res = slips.evaluate_rules(m, slips.rules_frame(spark))
    got = {(x.id, x.rule_code): x.result for x in res.collect()}
    assert len(got) == 24 and all(v == "pass" for (i, _), v in got.items() if i == "a")
    assert got["b", "TURNOUT_CEILING"] == got["b", "VOTES_WITHIN_REGISTERED"] == "fail"
    assert got["c", "VOTES_WITHIN_REGISTERED"] == got["c", "TURNOUT_CEILING"] == "pass" and got["c", "ALL_PAGES_PRESENT"] == "fail"
    assert {x.id: x.decision for x in slips.approval(m, res, r).collect()} == {"a": "approved", "b": "rule_failed", "c": "incomplete"}
    listed = slips.list_slips(s.selectExpr("*", "timestamp'2024-01-01' AS created_at", "'x' AS station_name", "'y' AS municipality"), res, search="v2").collect()
    assert [(x.id, x.has_errors) for x in listed] == [("b", True)]


def test_consolidate(spark):
    s, p, r = fixture(spark)
    out, votes = slips.consolidate(s, p, r)
    got = {x.id: (x.status, x.missing, x.total_received_pages) for x in out.collect()}
    assert got == {"a": ("pending_review", [], 1), "b": ("pending_review", [], 1), "c": ("incomplete", [2, 3], 1)}
    assert votes.where("slip_id = 'c'").agg({"votes": "sum"}).first()[0] == 558


def test_assignment_order(spark):
    def run(pages, votes=True):
        return assign.fold([("R", "V", "N", p, votes, i) for i, p in enumerate(pages)])

    assert run([1, 1, 2]) == ["R", "R (2)", "R (2)"]
    assert run([1, 1, 2, 2, 1]) == ["R", "R (2)", "R (2)", "R", "R (3)"]
    assert len(set(run([1, 1], False))) == 2
    rows = [(1, "A", "V", "N", 1, 3, True), (2, "B", "V", "N", 2, 3, True), (3, "C", "W", "N", 1, 3, True), (4, "A (2)", "V", "N", 3, 3, True)]
    got = {r.ingest_seq: r.slip_key for r in assign.assign_pages(spark.createDataFrame(rows, schemas.PAGE_RECORDS)).collect()}
    assert got == {1: "A", 2: "A", 3: "C", 4: "A"}


def test_score_audit_commands_integrity(spark, tmp_path):
    g, q = spark.createDataFrame([("f", "A", 1), ("f", "B", 0)], "file string, code string, votes int"), spark.createDataFrame([("f", "A", 1), ("f", "C", 0)], "file string, code string, votes int")
    assert {r.code: r.ok for r in slips.score(g, q, ["file", "code"]).collect()} == {"A": True, "B": False, "C": True}
    state = spark.createDataFrame([("1", 5), ("2", 6)], "id string, votes int")
    log = spark.createDataFrame([("1", 1, "votes", "7"), ("1", 2, "votes", "9"), ("2", 3, "deleted", "")], "id string, seq int, field string, value string")
    assert [tuple(r) for r in slips.fold_commands(state, log).collect()] == [("1", 9)]
    s, p, r = fixture(spark)
    s = s.withColumn("total_received_pages", s.total_expected_pages)
    assert slips.integrity(s, p.union(p), r).count() == 3
    files.write_csv(state, f"{tmp_path}/c")
    assert files.parse_list(" a, ,b") == ["a", "b"] and files.parse_list("") is None
    e = spark.createDataFrame([("read", 10.0, 1, 2)], "stage string, elapsed double, done int, total int")
    assert progress.progress(e).first().percent == 78


def test_stream_carries_forward(spark, tmp_path):
    spark.createDataFrame([("u", 1, "a", None), ("u", 2, None, "x"), ("v", 1, "b", None)], "k string, seq int, stage string, file string").write.json(f"{tmp_path}/in")
    events = files.read_ndjson(spark, f"{tmp_path}/in", "k string, seq int, stage string, file string", stream=True)
    q = progress.latest(events, "k", ["stage", "file"]).writeStream.outputMode("update").format("memory").queryName("latest_t").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.stage, r.file) for r in spark.table("latest_t").collect()} == {("u", "a", "x"), ("v", "b", None)}


def test_components_of_a_long_chain(spark):
    from tallyweave.operators import assign

    rows = [(f"b{i:02d}", f"d{j}", "X") for i in range(54) for j in (i, i + 1)]  # each family shares a district with the next
    d = spark.createDataFrame(rows, "slip_reference string, voting_district string, ballot_type string").coalesce(1)
    assert {r.comp for r in assign.with_components(d).select("comp").distinct().collect()} == {"b00"}


def test_judged_as_by_results(spark):
    """Flags told row by row are those of the results; every slip takes part, also without pages, rows, district or type."""
    s, p, r = fixture(spark)
    more = [slip("d", "National", 10, "approved", 5, 0, 5, 1, True, "V2"), slip("e", "National", 10, "approved", 5, 0, 5, 1, True, "V2"), slip("f", None, 10, "approved", 5, 0, 5, 1, False, "V2"), slip("g", None, 10, "approved", 5, 0, 5, 1, True, "V2")]
    s = s.union(spark.createDataFrame(more, s.schema))
    rules = slips.rules_frame(spark)
    m = slips.slip_metrics(slips.consolidate(s, p, r)[0].withColumn("is_vote_related", F.lit(True)), p, r)
    results = slips.evaluate_rules(m, rules)
    assert results.count() == 8 * 7 and results.rdd.getNumPartitions() == m.rdd.getNumPartitions()  # not each with each part of the rules
    j = slips.judged(m, rules)
    assert sorted(map(tuple, slips.eligibility(j).collect())) == sorted(map(tuple, slips.eligibility(m, results).collect()))
    assert sorted(map(tuple, slips.approval(j).collect())) == sorted(map(tuple, slips.approval(m, results, r).collect()))
    assert {x.id for x in slips.slip_metrics(s, p, r).where("twin").collect()} == {"b", "d", "e"}


def test_components_without_links_take_no_part(spark):
    """A node without a link keeps its label and is in none of the rounds' tables."""
    scratch = Scratch(spark)
    ids = spark.createDataFrame([(x, x) for x in "abcdef"], "id string, comp string")
    got = components(ids, spark.createDataFrame([("f", "c")], "a string, b string"), scratch)
    assert {r.id: r.comp for r in got.collect()} == {**{x: x for x in "abcde"}, "f": "c"}
    assert [t.count() for t, path in scratch.paths.values() if "/labels-" in path] == [2]


def test_components_hook_whole_trees(spark):
    """A chain in random order takes rounds that grow with its logarithm, not with its length."""
    order = [f"{i:03d}" for i in range(257)]
    random.Random(5).shuffle(order)
    scratch = Scratch(spark)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a string, b string").coalesce(1)
    rounds, own = [], scratch.cut
    scratch.cut = lambda d, what: rounds.append(what) or own(d, what)
    got = components(spark.createDataFrame([(x, x) for x in order], "id string, comp string").coalesce(1), links, scratch)
    assert {r.comp for r in got.collect()} == {"000"} and got.count() == 257
    assert rounds.count("labels") <= 12
