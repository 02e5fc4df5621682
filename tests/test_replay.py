"""Edits in order, against a plain replay command by command."""

import random

import pytest

from tallyweave.operators import replay, workflow
from tallyweave.operators import slips as rules_of

SLIP = "id string, slip_reference string, status string, station_name string, registered_voters int, total_valid_votes int"
PAGE = "id string, slip_id string"
PARTY = "id string, slip_id string, page_id string, votes int, is_overridden boolean"


def plain(slips, pages, party, log):
    """(slips, pages, votes, refused) after the log, with nothing but dictionaries."""
    fields = {s[0]: dict(zip(("slip_reference", "status", "station_name", "registered_voters", "total_valid_votes"), s[1:], strict=True)) for s in slips}
    alive = {k: dict(v) for k, v in fields.items()}
    where, votes, no = dict(pages), {p[0]: p[3] for p in party}, {}
    page_of = {p[0]: p[2] for p in party}

    def drop(slip):
        del alive[slip]
        for p in [p for p, s in where.items() if s == slip]:
            del where[p]

    for seq, action, slip, page, row, field, value, reason in sorted(log):
        page = page_of.get(row) if action == "override_party_votes" else page
        if action == "clear_all_slips":
            alive.clear()
            where.clear()
            continue
        if action == "create_slip":
            if slip in alive:
                no[seq] = "slip is there"
            else:
                alive[slip] = dict(fields.get(slip, {"new": True}))
            continue
        if action in ("manual_link_page", "manual_unlink_page", "remove_page", "override_party_votes"):
            if page not in where:
                no[seq] = "no such page"
            elif action.startswith("manual") and len((reason or "").strip()) < 5:
                no[seq] = "a reason of 5 characters is needed"
            elif not action.startswith("manual") and slip is not None and slip != where[page]:
                no[seq] = "not on this slip"
            elif action == "override_party_votes":
                if value is None or not value.lstrip("-").isdigit():
                    no[seq] = "bad value"
                else:
                    votes[row] = max(0, int(value))
            elif action == "manual_link_page":
                if value not in alive:
                    no[seq] = "no such slip"
                else:
                    where[page] = value
            elif action == "manual_unlink_page":
                old = alive.get(where[page])
                if old is None:
                    no[seq] = "no such slip"
                    continue
                own = replay.own_slip(slip, page, seq)
                alive[own] = old | {"status": "incomplete", "total_valid_votes": 0, "slip_reference": f"{fields.get(old.get('root', where[page]), old)['slip_reference']}_unlinked_{own[-4:]}", "root": old.get("root", where[page])}
                where[page] = own
            else:
                at = where.pop(page)
                if at not in where.values() and at in alive:
                    drop(at)
            continue
        if slip not in alive:
            no[seq] = "no such slip"
        elif action == "delete_slip":
            drop(slip)
        elif action == "edit_slip_field":
            if field not in ("station_name", "registered_voters", "total_valid_votes"):
                no[seq] = "not editable"
            elif field != "station_name" and value is not None and not value.isdigit():
                no[seq] = "bad value"
            else:
                alive[slip][field] = int(value) if field != "station_name" and value is not None else value
        else:
            alive[slip]["status"] = replay.STATUS[action]
    rows = {k: (v["slip_reference"], v["status"], v["station_name"], v["registered_voters"], v["total_valid_votes"]) for k, v in alive.items() if "slip_reference" in v}
    return rows, where, {r: (votes[r], where[page_of[r]]) for r in votes if page_of[r] in where}, no


def check(spark, slips, pages, party, log):
    s, p, r = spark.createDataFrame(slips, SLIP), spark.createDataFrame(pages, PAGE), spark.createDataFrame(party, PARTY)
    full = [(seq, a, sl, pg, row, "u", f, v, why, None) for seq, a, sl, pg, row, f, v, why in log]
    c = spark.createDataFrame(full, workflow.COMMANDS).repartition(3)
    done = replay.replay(s, p, c, r)
    want = plain(slips, pages, party, log)
    assert {x.seq: x.why for x in replay.refused(c, done).collect()} == want[3]
    assert {x.id: x.slip_id for x in replay.pages_now(p, done).collect()} == want[1]
    assert {x.id: (x.votes, x.slip_id) for x in replay.party_now(r, c, done).collect()} == want[2]
    assert {x.id: (x.slip_reference, x.status, x.station_name, x.registered_voters, x.total_valid_votes) for x in replay.slips_now(s, c, done).collect()} == want[0]
    return done, c


SLIPS = [(f"s{i}", f"R{i}", "pending_review", f"hall {i}", 100 + i, 7) for i in range(12)]
PAGES = [(f"p{i}", f"s{i % 13}") for i in range(30)]  # s12 isn't there
ROWS = [(f"r{i}", f"s{i % 30 % 13}", f"p{i % 30}", i, False) for i in range(40)]


def test_order_matters(spark):
    say = lambda seq, action, slip=None, page=None, field=None, value=None, reason="wrong slip", row=None: (seq, action, slip, page, row, field, value, reason)
    log = [
        say(1, "edit_slip_field", "s0", field="registered_voters", value="55"), say(2, "edit_slip_field", "s0", field="registered_voters", value="12x"),
        say(3, "edit_slip_field", "s0", field="status", value="approved"), say(4, "override_party_votes", None, row="r1", value="abc"),
        say(5, "override_party_votes", None, row="r2", value=None), say(6, "override_party_votes", None, row="r3", value="-9"),
        say(7, "delete_slip", "s1"), say(8, "create_slip", "s1"), say(9, "manual_link_page", None, "p2", value="s1"),
        say(10, "manual_link_page", None, "p1", value="s2"), say(11, "remove_page", "s3", "p3"), say(12, "remove_page", "s3", "p16"),
        say(13, "remove_page", "s3", "p29"), say(14, "manual_link_page", None, "p4", value="s3"), say(15, "manual_unlink_page", "s5", "p5"),
        say(16, "manual_unlink_page", None, "p12"), say(17, "manual_link_page", None, "p12", value="s5"), say(18, "remove_page", "s6", "p7"),
        say(19, "edit_slip_field", "s1", field="station_name", value="new"), say(20, "approve_slip", "s9"), say(21, "reject_slip", "s9"),
        say(22, "manual_link_page", None, "p8", value="s9", reason=" no "), say(23, "delete_slip", "s99"), say(24, "edit_slip_field", "s0", field="station_name", value=None),
    ]
    done, c = check(spark, SLIPS, PAGES, ROWS, log)
    told = {r.seq: (r.action, r.slip_id, r.old_value, r.new_value) for r in replay.audit_rows(c, done).collect()}
    assert told[9] == ("manual_link_page", "s1", "s2", "s1") and told[11] == ("remove_page_image", "s3", None, None)
    assert told[15][2] == "s5" and told[15][3].startswith("s5_unlinked_") and 10 not in told
    lives = {(r.slip_id, r.since, r.until) for r in done.lives.collect()}
    assert {("s1", None, 7), ("s1", 8, None), ("s3", None, 13), ("s0", None, None)} <= lives
    check(spark, SLIPS, PAGES, ROWS, [*log, (30, "clear_all_slips", None, None, None, None, None, None), say(31, "create_slip", "s2"), say(32, "manual_link_page", None, "p2", value="s2"), say(33, "create_slip", "s2"), say(34, "reject_slip", "s2")])


@pytest.mark.parametrize("seed", [3, 4])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    actions = ["manual_link_page"] * 5 + ["manual_unlink_page"] * 2 + ["remove_page"] * 3 + ["delete_slip", "create_slip", "create_slip", "edit_slip_field", "edit_slip_field", "approve_slip", "reject_slip", "flag_slip"] + ["override_party_votes"] * 2
    log = []
    for seq in range(150):
        a = rng.choice(actions) if seq != 110 or seed == 3 else "clear_all_slips"
        slip, page = f"s{rng.randrange(13)}", f"p{rng.randrange(30)}"
        page_act = a in ("manual_link_page", "manual_unlink_page", "remove_page")
        value = f"s{rng.randrange(12)}" if a == "manual_link_page" else rng.choice(["5", "x", None, "900"])
        log.append((seq, a, None if page_act and rng.random() < 0.6 or a == "override_party_votes" else slip, page if page_act else None, f"r{rng.randrange(40)}" if a == "override_party_votes" else None, rng.choice(["station_name", "registered_voters", "total_valid_votes", "status"]) if a == "edit_slip_field" else None, value, rng.choice(["wrong slip", "no", None, "other one"])))
    check(spark, SLIPS, PAGES, ROWS, log)


def test_approval_sees_the_slip_as_it_was(spark):
    cols = "id string, slip_reference string, ballot_type string, voting_district string, status string, station_name string, registered_voters int, total_valid_votes int, total_spoilt_votes int, total_votes_cast int, special_votes int, section_24a_votes int, total_expected_pages int, presiding_officer_signature_detected boolean"
    s = spark.createDataFrame([(k, k, "N", k, "pending_review", "h", 100, 10, 0, 10, 0, 0, 2, True) for k in ("a", "b")], cols)
    p = spark.createDataFrame([("p1", "a", 1, []), ("p2", "b", 2, []), ("p3", "b", 1, [])], "id string, slip_id string, page_number int, exception_flags array<string>")
    r = spark.createDataFrame([("r1", "a", "p1", 0, "X", "X", 4, 0.9, False, True), ("r2", "b", "p2", 0, "Y", "Y", 6, 0.5, False, True), ("r3", "b", "p3", 0, "Z", "Z", 4, 0.9, False, True)], "id string, slip_id string, page_id string, row_index int, party_name string, party_code string, votes int, confidence_score double, is_overridden boolean, signature_detected boolean")
    log = [(1, "approve_slip", "a"), (2, "approve_slip", "b"), (3, "override_party_votes", None, None, "r2", "7"), (4, "approve_slip", "b"), (5, "override_party_votes", None, None, "r2", "6"), (6, "approve_slip", "b"), (7, "manual_link_page", None, "p2", None, "a"), (8, "approve_slip", "a"), (9, "approve_slip", "nobody"), (10, "approve_slip", "b")]
    c = spark.createDataFrame([(x[0], x[1], x[2], x[3] if len(x) > 3 else None, x[4] if len(x) > 4 else None, "u", None, x[5] if len(x) > 5 else None, "moved", None) for x in log], workflow.COMMANDS)
    done = replay.replay(s, p, c, r)
    found = replay.decisions(s, p, r, c, rules_of.rules_frame(spark), done)
    got = {x.seq: x.decision for x in found.collect()}
    assert got == {1: "incomplete", 2: "low_confidence", 4: "rule_failed", 6: "approved", 8: "approved", 10: "incomplete"}
    assert {x.id: (x.status, x.approved_by) for x in replay.slips_now(s, c, done, found).collect()} == {"a": ("approved", "u"), "b": ("approved", "u")}
    assert {x.seq: x.why for x in replay.refused(c, done, found).collect()} == {1: "incomplete", 2: "low_confidence", 4: "rule_failed", 9: "no such slip", 10: "incomplete"}


def test_empty(spark):
    check(spark, [], [], [], [])
    check(spark, SLIPS, PAGES, ROWS, [])
