"""The text report line by line."""

import glob

from tallyweave.operators import reports

WANT = """Sample report
Path: here

=== SUMMARY ===
Images: 4  labeled: 2  unlabeled: 1
IEC result slips: 3/5 fields  (60.0%)
All labeled files: 3/5 fields  (60.0%)
Misses (gold fields): 2
Extra non-zero votes not in gold: 1

=== MISSES (quick compare) ===
a.jpg  page_number: got —  expected 2
a.jpg  votes.AB: got 3  expected 4
a.jpg  votes.ZZ: got 9  expected 0 (not in gold)  EXTRA
d.jpg: FAIL  unreadable

=== UNLABELED — retrieved values (no gold to score) ===

c.jpg  0.00s
field                        retrieved
ballot_type                  Ward
{blank}
exception_flags              odd, late
retrieved votes: (none)

=== PER FILE ===

{rule}
a.jpg  MISS  1.50s  2/4 gold fields
{dash}
field                        got                    expected               status
ballot_type                  Ward                   Ward                   OK
page_number                  —                      2                      MISS
votes.AB                     3                      4                      MISS
votes.CD                     0                      0                      OK

Extra non-zero votes not listed in gold:
  ZZ  Zed  got 9  conf 0.50  EXTRA

Retrieved party votes:
  AB           3  conf 0.91  Ab
  ZZ           9  conf 0.50  Zed
  (1 other party retrieved as 0)
exception_flags: odd

{rule}
b.jpg  PASS  2.00s  1/1 gold fields
{dash}
field                        got                    expected               status
ballot_type                  Ward                   Ward                   OK

Retrieved party votes:
  (all zero)
  (2 other parties retrieved as 0)

{rule}
c.jpg  unlabeled  0.00s
field                        retrieved
ballot_type                  Ward
{blank}
exception_flags              odd, late
retrieved votes: (none)

{rule}
d.jpg  FAIL  unreadable
"""


def frames(spark):
    pages = spark.createDataFrame([("a.jpg", 1.5, None, True, ["odd"], "Ward"), ("b.jpg", 2.0, None, True, None, "Ward"), ("c.jpg", None, None, False, ["odd", "late"], "Ward"), ("d.jpg", 0.1, "unreadable", None, None, None)], "file string, seconds double, error string, labeled boolean, exception_flags array<string>, ballot_type string")
    checks = spark.createDataFrame([("a.jpg", "ballot_type", "exact", "Ward", "Ward", True), ("a.jpg", "page_number", "exact", None, "2", False), ("a.jpg", "votes.AB", "vote", "3", "4", False), ("a.jpg", "votes.CD", "blank_vote", "0", "0", True), ("b.jpg", "ballot_type", "exact", "Ward", "Ward", True), ("d.jpg", "ballot_type", "exact", None, "Ward", False)], "file string, field string, kind string, actual string, expected string, ok boolean")
    votes = spark.createDataFrame([("a.jpg", 1, "AB", "Ab", 3, 0.91), ("a.jpg", 2, "CD", "Cd", 0, 0.9), ("a.jpg", 3, "ZZ", "Zed", 9, 0.5), ("b.jpg", 1, "AB", "Ab", 0, None), ("b.jpg", 2, "CD", None, 0, None)], "file string, row_index int, code string, name string, votes int, confidence double")
    return pages, checks, votes


def test_text_report(spark, tmp_path):
    pages, checks, votes = frames(spark)
    lines = reports.text_report(pages, checks, votes, pages.selectExpr("file", "'slip' AS template"), ["Sample report", "Path: here"])
    blank = "\n".join(f"{f:<28} —" for f in reports.SNAPSHOT[1:])
    want = WANT.replace("{rule}", "=" * 72).replace("{dash}", "-" * 72).replace("{blank}", blank)
    assert "\n".join(r.line for r in reports.ordered(lines).collect()) + "\n" == want + "\n"
    reports.write_report(lines, f"{tmp_path}/r", 3)
    assert "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/r/part-*"))) == want + "\n"


def test_nothing_to_report(spark):
    pages, checks, votes = (d.limit(0) for d in frames(spark))
    got = [r.line for r in reports.ordered(reports.text_report(pages, checks, votes, pages.selectExpr("file", "'slip' AS template"), ["Head"])).collect()]
    assert got == ["Head", "", "=== SUMMARY ===", "Images: 0  labeled: 0  unlabeled: 0", "Misses (gold fields): 0", "Extra non-zero votes not in gold: 0", "", "=== MISSES (quick compare) ===", "(none)", "", "=== PER FILE ===", ""]


def test_console_and_snapshot(spark):
    pages, checks, _ = frames(spark)
    got = [r.line for r in reports.ordered(reports.console_lines(pages, checks)).collect()]
    assert got == ["  MISS  a.jpg  1.50s  2/4 fields", "        page_number: got —, expected 2", "        votes.AB: got 3, expected 4", "  PASS  b.jpg  2.00s  1/1 fields", "  ----  c.jpg  0.00s  unlabeled", "  FAIL  d.jpg  (unreadable)"]
    rec = spark.createDataFrame([("a", "Ward", None, [("AB", "Ab", 3, 0.5)]), ("b", None, ["x"], None)], "file string, ballot_type string, exception_flags array<string>, party_results array<struct<party_code:string,party_name:string,votes:int,confidence_score:double>>")
    s = {r.file: r for r in reports.snapshot(rec).collect()}
    assert s["a"].ballot_type == "Ward" and s["a"].exception_flags == [] and s["a"].parties[0].votes == 3 and s["a"].province is None and s["b"].parties == []
