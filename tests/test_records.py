"""Page text, placed tokens, edits, scoring and exports against values that are known."""

import json

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import forms
from tallyweave.operators import assign, scoring, slips, workflow
from tallyweave.plans import catalogue
from tallyweave.sources import exports, files
from tallyweave.streaming import progress


def item(text, cx, cy, score=0.9, half=10):
    return f"named_struct('text', '{text}', 'score', {score}D, 'cx', {cx}D, 'cy', {cy}D, 'x1', {cx - half}D, 'x2', {cx + half}D, 'y1', {cy - 6}D, 'y2', {cy + 6}D)"


GOLDEN = [
    ("find_registered(array('a', 'Registered Voters', 'page 7', '19', '1149'))", 1149), ("find_registered(array('RegisteredVoters1149'))", 1149), ("find_registered(array('none'))", None),
    ("find_station(array('VD 12345678', 'PAGE 1', 'x'))", None), ("find_station(array('x', 'Old  School'))", "OLD SCHOOL"), ("find_municipality('xx ABC123 – Big Town Registered 5')", "ABC123 - Big Town"), ("find_province('NORTH  WEST', array())", "North West"),
    ("totals_of(array('TOTAL VALID VOTES CAST: 4 8 1', 'x')).valid", 481), ("totals_of(array('TOTAL VOTES CAST 1', 'TOTAL VOTES CAST 493')).cast", 493), ("totals_of(array('x')).valid", None),
    ("reconciled(481, NULL, 493).spoilt", 12), ("reconciled(481, 1, 493).spoilt", 12), ("reconciled(NULL, 12, 493).valid", 481), ("reconciled(481, 12, NULL).cast", 493), ("reconciled(3195, 12, 2513195).cast", 3207), ("reconciled(481, 5, 700).cast", 700), ("reconciled(NULL, NULL, NULL).cast", None),
    ("looks_like_slip(array('result slip', 'results'), false, '', 0)", True), ("looks_like_slip(array('votes'), false, '', 0)", False), ("looks_like_slip(array(), true, NULL, 0)", True), ("looks_like_slip(array(), NULL, NULL, 3)", True),
    ("classify_form(array('yellow ballot'), NULL, NULL).ballot_type", "District Council PR"), ("classify_form(array('x'), true, 'Ward').reason", "result_grid"), ("classify_form(array('x'), false, 'Ward').reason", "colour_bar"), ("classify_form(array('x'), NULL, NULL).reason", "default_iec"),
    ("snap_code('tr-ab', array('TRAAB'), array())", "TRAAB"), ("snap_code('TRAGX', array('TRAGJ', 'TRAAB'), array())", "TRAGJ"), ("snap_code('TRXX', array('TRAAB'), array('TRXX'))", None), ("snap_code('AB', array(), array())", None),
    ("slip_ref(NULL, NULL, 'National', 1)", "UNREAD_NAT_p1"), ("digit_token('S1 l了')", "5117"), ("duration_text(-3D)", "0:00"), ("shown_conf(NULL)", "—"), ("turnout_text(5, 0)", "0.0"), ("relative_time(-150).n", -2), ("relative_time(59).unit", "second"), ("status_label('x_y')", "x y"), ("ballot_class('Local Council PR')", "local-council-pr"),
    ("to_json(running_clusters(array(1D, 2D, 9D, 3D), 2D))", '[{"centre":2.0,"n":3},{"centre":9.0,"n":1}]'), ("to_json(aligned_rows(array(10, 30, 50), 4))", '[{"y1":10,"y2":30},{"y1":30,"y2":50},{"y1":50,"y2":70},{"y1":70,"y2":90}]'), ("size(aligned_rows(array(5), 3))", 0), ("size(aligned_rows(array(5, 6), 0))", 0),
    (f"row_hits(array({item('12', 300, 50)}, {item('x', 350, 50)}, {item('7', 200, 50)}), {item('label', 50, 50)})[1].votes", 12),
    (f"token_totals(array({item('TOTAL VALID VOTES', 50, 50)}, {item('12', 300, 50)}, {item('481', 500, 50)}, {item('29', 800, 50)}), 1000D).valid", 481),
    (f"token_totals(array({item('TOTAL VALID VOTES', 50, 50)}, {item('481', 500, 50)}, {item('493', 800, 50)}), 1000D).valid", 493),
    (f"number_on_row(array({item('4', 20, 50)}, {item('8', 40, 50)}, {item('12', 60, 52)}), 40D, 60D, 0D, 100D, NULL).votes", 4),
    (f"cell_votes(array({item('x', 20, 50)}), 40D, 60D, 0D, 100D).conf", 0.42), (f"cell_votes(array({item('-', 20, 50)}), 40D, 60D, 0D, 100D).votes", 0),
    (f"size(party_rows(array({item('TRAAN', 20, 50)}, {item('TRAAN', 20, 55)}, {item('TRAG', 20, 70)}), 'Ward', 100D))", 2),
]


def test_page_text(spark):
    forms.register(spark)
    row = spark.range(1).selectExpr(*[f"{e} AS c{i}" for i, (e, _) in enumerate(GOLDEN)]).first()
    assert [(e, v) for (e, _), v in zip(GOLDEN, row, strict=True)] == GOLDEN


def commands(spark, rows):
    full = [(i, a, s, p, r, "u", f, v, why, None) for i, (a, s, p, r, f, v, why) in enumerate(rows)]
    return spark.createDataFrame(full, workflow.COMMANDS)


def test_edits_fold(spark):
    s = spark.createDataFrame([("a", "st", 5, "incomplete"), ("b", "st", 6, "approved"), ("c", "st", 7, "flagged")], "id string, station_name string, registered_voters int, status string")
    c = commands(spark, [("edit_slip_field", "a", None, None, "station_name", "new", None), ("edit_slip_field", "a", None, None, "status", "approved", None), ("edit_slip_field", "a", None, None, "registered_voters", "x", None), ("reject_slip", "b", None, None, None, None, "bad"), ("approve_slip", "c", None, None, None, None, None), ("delete_slip", "c", None, None, None, None, None)])
    got = {r.id: (r.station_name, r.registered_voters, r.status, r.rejection_reason) for r in workflow.edited_slips(s, c).collect()}
    assert got == {"a": ("new", 5, "incomplete", None), "b": ("st", 6, "rejected", "bad")}
    assert {r.id for r in workflow.edited_slips(s, commands(spark, [("clear_all_slips", None, None, None, None, None, None), ("create_slip", "b", None, None, None, None, None)])).collect()} == {"b"}
    log = {r.id: (r.action, r.old_value, r.new_value) for r in workflow.audit_of(c, s).collect()}
    assert log["aud_0"] == ("edit_slip_field", "st", "new") and "aud_1" not in log and log["aud_5"][0] == "delete_slip"
    p = spark.createDataFrame([("r1", "a", "p1", 9, False)], "id string, slip_id string, page_id string, votes int, is_overridden boolean")
    row = workflow.overridden_party(p, commands(spark, [("override_party_votes", "a", None, "r1", None, "-4", None)])).first()
    assert (row.votes, row.is_overridden, row.original_ocr_votes, row.overridden_by) == (0, True, 9, "u")
    row = workflow.overridden_party(p, commands(spark, [("override_party_votes", "a", None, "r1", None, "abc", None), ("override_party_votes", "a", None, "r1", None, None, None)])).first()
    assert (row.votes, row.is_overridden, row.overridden_by) == (9, False, None)
    pages = spark.createDataFrame([("p1", "a", 1), ("p2", "a", 2), ("p3", "b", 1), ("p4", "d", 1)], "id string, slip_id string, page_number int")
    c = commands(spark, [("manual_link_page", "a", "p1", None, None, "b", "wrong one"), ("manual_link_page", "a", "p2", None, None, "b", "no"), ("remove_page", "b", "p3", None, None, None, None), ("delete_slip", "d", None, None, None, None, None)])
    assert {(r.id, r.slip_id) for r in workflow.linked_pages(pages, c).collect()} == {("p1", "b"), ("p2", "a")}
    assert workflow.following(p, workflow.linked_pages(pages, c)).first().slip_id == "b"


def test_scores(spark):
    pages = spark.createDataFrame([("f", "Big Town X", 2, 481), ("g", None, 1, 0)], "file string, municipality string, page_number int, total_valid_votes int")
    gold = spark.createDataFrame([("f", "town", 2, None), ("h", "x", 1, 1)], "file string, municipality string, page_number int, total_valid_votes int")
    v = spark.createDataFrame([("f", "A", 0, 1), ("f", "A", 1, 5), ("f", "B", 0, 0), ("g", "A", 0, 3)], "file string, party_code string, row_index int, votes int")
    t = spark.createDataFrame([("f", "A", 5), ("f", "C", 2)], "file string, party_code string, votes int")
    checks = scoring.compare_pages(pages, gold, v, t)
    assert {(r.file, r.field, r.ok) for r in checks.collect()} == {("f", "municipality", True), ("f", "page_number", True), ("f", "votes.A", True), ("f", "votes.B", True), ("f", "votes.C", False)}
    c = scoring.counters(checks, spark.createDataFrame([("f", None)], "file string, template string")).first()
    assert (c.labeled_hits, c.labeled_total, c.nonzero_vote_hits, c.nonzero_vote_total, c.blank_vote_hits) == (4, 5, 1, 2, 1)
    lines = [r.line for r in scoring.report_lines(checks, gold.selectExpr("file", "'iec_slip' AS template"), False).orderBy("at").collect()]
    assert lines[0] == "All fields: 4/5 = 80.0 %" and lines[-1] == "  votes.C: — (2)"
    assert scoring.gate(checks, 80.0).first().passed and not scoring.gate(checks.where("false"), 1.0).first().passed


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([("a", 'Hall "x", y', "approved", 1, 1)], "id string, station_name string, status string, total_expected_pages int, total_received_pages int")
    s = s.selectExpr("*", "'R' AS slip_reference", "'Ward' AS ballot_type", "'E' AS election_name", "NULL AS province", "'M' AS municipality", "'V' AS voting_district", "5 AS registered_voters", "4 AS total_valid_votes", "0 AS total_spoilt_votes", "4 AS total_votes_cast", "0 AS special_votes", "timestamp'2024-01-01' AS created_at")
    p = spark.createDataFrame([("p", "a", 1)], "id string, slip_id string, page_number int")
    r = spark.createDataFrame([("r", "a", "p", 0, "N" * 40, "C", 4, 0.955, False, True)], "id string, slip_id string, page_id string, row_index int, party_name string, party_code string, votes int, confidence_score double, is_overridden boolean, signature_detected boolean")
    assert len(exports.summary(s).columns) == 21 and exports.summary(s).first()["Province"] == "" and exports.summary(s, "flagged").count() == 0
    lines = [x.line for x in exports.detailed(s, p, r).orderBy("at").collect()]
    assert lines[5] == 'Station Name,"Hall ""x"", y"' and lines[8] == "" and lines[-1].startswith("1,1,NNN") and lines[-1].endswith(",C,4,0.96,NO,YES") or lines[-1].endswith(",C,4,0.95,NO,YES")
    rules = spark.createDataFrame([("a", "X", "pass")], "id string, rule_code string, result string")
    log = spark.createDataFrame([("2", "a", 5), ("1", "a", 4)], "id string, slip_id string, timestamp int")
    doc = json.loads(exports.documents(s, p, r, rules, log).select(F.to_json("doc", {"ignoreNullFields": "false"})).first()[0])
    assert [x["id"] for x in doc["audit_trail"]] == ["1", "2"] and doc["slip"]["province"] is None and len(doc["party_results"]) == 1
    c = exports.certificate(s, p, r).first()
    assert len(c.name) == 35 and c.confidence in ("95%", "96%")


def test_documents_of_party_rows_that_lie_with_their_page(spark):
    s = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "id string, station_name string")
    p = spark.createDataFrame([("p2", "a", 2), ("p1", "a", 1), ("p0", "a", None), ("q", "b", 1), ("q", "b", 3)], "id string, slip_id string, page_number int")
    r = [("r1", "a", "p1", 1, "C"), ("r0", "a", "p2", 0, "D"), ("r2", "a", "p1", 0, None), ("r3", "a", "p0", 0, "E"), ("t", "b", "q", 0, "F"), ("gone", "b", "none", 0, "G"), ("none", "b", None, 0, "H")]
    r = spark.createDataFrame(r, "id string, slip_id string, page_id string, row_index int, party_code string")
    rules = spark.createDataFrame([("a", "Y", "fail"), ("a", "X", "pass")], "id string, rule_code string, result string")
    log = spark.createDataFrame([("2", "a", 5), ("1", "a", 4)], "id string, slip_id string, timestamp int")
    text = lambda **how: {x.slip_id: x.json for x in exports.documents(s, p, r, rules, log, **how).select("slip_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("json")).collect()}
    got = text(together=True)
    assert got == text() and len(got) == 3
    assert [x["id"] for x in json.loads(got["a"])["party_results"]] == ["r3", "r2", "r1", "r0"]
    assert [(x["id"], x["page_number"]) for x in json.loads(got["b"])["party_results"]] == [("t", 1), ("t", 3)]


def test_nested_details_shuffle_files_rather_than_documents(spark):
    """Rules by kin, results and the audit trail by slip; the rest lies by slip since it was read."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(was, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        plan = catalogue.queries()["nested_detail_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("ENSURE_REQUIREMENTS" in line for line in dealt) == 3 and not any("page_id" in line for line in dealt)


def test_sources(spark, tmp_path):
    assert files.load_gold(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"a.jpg": {"template": "worksheet", "votes": {"A": 3}, "totals": {"valid": 9}}}))
    g = files.load_gold(spark, f"{tmp_path}/g.json")
    assert files.gold_votes(g).first().votes == 3 and files.gold_pages(g).first().total_valid_votes == 9
    d = spark.createDataFrame([("a.JPG", 3), ("b.txt", 1), ("c.pdf", 2)], "name string, length long")
    assert {r.name for r in files.uploads(d).collect()} == {"a.JPG", "c.pdf"}
    assert [r.page_index for r in files.page_rows(spark.createDataFrame([("a", 2), ("b", 0)], "f string, n_pages int")).collect()] == [0, 1]
    packs = files.packs(spark.createDataFrame([("x", ["c.pdf", "a.JPG"]), ("y", ["zz", "b.txt"])], "pack_id string, names array<string>"), d)
    assert {r.pack_id: (r.available, r.present) for r in packs.collect()} == {"x": (True, ["c.pdf", "a.JPG"]), "y": (False, ["b.txt"])}
    shown = files.presented(spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS t, array() AS e, named_struct('x', 1) AS b")).first()
    assert shown.t.startswith("2024-01-02T03:04:05") and shown.e is None and shown.b == '{"x":1}'
    assert files.run_sql(spark, "SELECT ? + 1 AS x", [41]).first().x == 42
    files.append_rows(d, f"{tmp_path}/t")
    files.append_rows(d, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6
    users = spark.createDataFrame(schemas.USER_SEED, schemas.USERS)
    assert workflow.seeded(users.limit(1), users, "id").count() == 3


def test_progress_protocol(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "started", None), ("a", 2, "complete", None), ("b", 1, "started", None), ("c", 1, "error", "boom"), ("c", 2, "complete", None)], "request_id string, seq int, event string, detail string")
    assert {r.request_id: (r.outcome, r.detail) for r in progress.outcomes(e).collect()} == {"a": ("complete", None), "b": ("aborted", None), "c": ("error", "boom")}
    row = progress.progress(spark.createDataFrame([("grouping", 10.0, 1, 2), ("complete", 1.0, 2, 2)], "stage string, elapsed double, done int, total int")).collect()
    assert [(r.event, r.message) for r in row] == [("progress", "Matching the page to a slip"), ("complete", "Finished")]


def test_upload_and_approval_flags(spark):
    u = spark.createDataFrame([("a", 1, 3, [2], [1, 3], "incomplete", "B"), ("a", 2, 2, [2, 1], [3], "incomplete", "")], "slip_id string, seq int, page_total int, pages array<int>, missing array<int>, status string, barcode_text string")
    r = slips.upload_summary(u).first()
    assert (r.expected, r.received, r.missing, r.barcode_text, r.next_page) == (3, [1, 2], [3], "B", 3)
    s = spark.createDataFrame([("a", True, "pending_review"), ("b", True, "incomplete"), ("c", False, "pending_review")], "id string, is_vote_related boolean, status string")
    f = spark.createDataFrame([("a", False, 0)], "id string, has_errors boolean, unchecked long")
    assert {x.id for x in slips.may_approve(s, f).where("enabled").collect()} == {"a"}


def test_medians_are_exact(spark):
    import random
    import statistics

    from tallyweave.operators import stats

    rng = random.Random(5)
    groups = {"a": [rng.random() for _ in range(5001)], "b": [rng.randrange(3) for _ in range(4000)], "c": [7.0], "d": [1.0, 2.0], None: [3.0, 3.0, 9.0], "e": [-1.0, 1.0]}
    rows = [(k, float(v), 1.0) for k, vs in groups.items() for v in vs] + [("a", None, 1.0), ("z", None, 1.0)]
    got = {r.k: (r.n, r.med, r.cv) for r in stats.summaries(spark.createDataFrame(rows, "k string, v double, w double"), "k", "v", "w").collect()}
    assert {k: (n, m) for k, (n, m, _) in got.items()} == {k: (len(v), statistics.median(map(float, v))) for k, v in groups.items()} and got["e"][2] is None


def test_evidence_for_a_value(spark):
    o = [("a", 7, 0.5, "row"), ("a", 7, 0.6, "row"), ("a", 8, 0.66, "cells"), ("b", 3, 0.1, "row"), ("c", None, 0.9, "row"), ("d", 4, 0.99, "row"), ("d", 4, None, "row"), ("e", 5, 0.5, "x"), ("e", 5, 0.5, "y"), ("e", 5, 0.5, "z"), ("e", 5, 0.5, "z"), ("e", 5, 0.5, "z"), ("f", 2, 0.4, "x"), ("f", 1, 0.4, "x")]
    got = {r.k: (r.value, round(r.confidence, 6)) for r in scoring.consensus(spark.createDataFrame(o, "k string, value int, score double, source string"), "k").collect()}
    assert got == {"a": (8, 0.66), "b": (3, 0.25), "c": (0, 0.3), "d": (4, 0.92), "e": (5, 0.58), "f": (1, 0.4)}
    c = [("a", "7", 0.9, None), ("a", "7", 0.9, None), ("a", "12", 0.33, None), ("b", "12", 0.31, None), ("c", "4", 0.79, None), ("d", "4", 0.79, True), ("e", "123", 0.9, None), ("e", "x", 0.9, None), ("f", "5", 0.81, None), ("f", "6", 0.81, None), ("g", "44", 0.2, True), ("g", "4", 0.9, None)]
    got = {r.k: (r.digits, r.score) for r in scoring.cell_token(spark.createDataFrame(c, "k string, digits string, score double, hint boolean"), "k").collect()}
    assert got == {"a": ("12", 0.33), "b": (None, None), "c": (None, None), "d": ("4", 0.79), "f": ("5", 0.81), "g": ("4", 0.9)}
