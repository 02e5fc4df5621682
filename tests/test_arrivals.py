"""Pages that arrive in micro-batches are placed as if all had been there at once, whatever is restarted."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import assign
from tallyweave.streaming import arrivals, progress


def plain(rows):
    """The fold written down anew: the newest slip of the family, then of the district, that lacks the page."""
    slips, out = [], {}
    for seq, ref, district, kind, page, _, votes in sorted(rows):
        base = ref.rpartition(" (")[0] if ref.endswith(")") and ref.rpartition(" (")[2][:-1].isdigit() else ref
        known = bool(district) and district.upper() != "UNKNOWN"
        places = [lambda s: s["base"] == base, lambda s: known and s["site"] == (district, kind)]
        hit = next((s for fits in places for s in reversed(slips) if votes and s["votes"] and fits(s) and page not in s["pages"]), None)
        if hit is None:
            taken, key, n = {s["key"] for s in slips}, base, 2
            while key in taken:
                key, n = (f"{base} ({n})", n + 1) if votes else (f"{base} #{seq}", n)
            hit = {"key": key, "base": base, "site": (district, kind) if known else None, "votes": votes, "pages": set()}
            slips.append(hit)
        hit["pages"].add(page)
        out[seq] = hit["key"]
    return out


def draw(rng, n, families, districts):
    return [(i, rng.choice([f"R{f}", f"R{f} (2)"]), rng.choice([f"D{d}" for d in range(districts)] + ["unknown", None, ""]), rng.choice("NP"), rng.randint(1, 4), 4, rng.random() > 0.1) for i, f in enumerate(rng.choices(range(families), k=n))]


@pytest.mark.parametrize("families,districts", [(3, 2), (40, 15), (200, 300)])
def test_batch_like_the_fold(spark, families, districts):
    rows = draw(random.Random(families), 600, families, districts)
    got = {r.ingest_seq: r.slip_key for r in assign.assign_pages(spark.createDataFrame(rows, schemas.PAGE_RECORDS).repartition(5)).collect()}
    assert got == plain(rows)


def test_a_page_costs_the_same_however_many_slips_are_open():
    import time

    def took(n):
        desk, began = assign.Desk(), time.process_time()
        for i in range(n):
            desk.place("R", "D", "N", i % 3 if i % 7 else 1, True, i)
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 60 * max(took(2000), 0.002)


def in_batches(spark, path, rows, bounds, again=()):
    d, store = spark.createDataFrame(rows, schemas.PAGE_RECORDS), arrivals.Arrivals(spark, path, buckets=4)
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = d.where((F.col("ingest_seq") >= lo) & (F.col("ingest_seq") < hi))
        if n in again:  # it stops before its log is there
            stopped = arrivals.Arrivals(spark, path, buckets=4)
            stopped._tell = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
            with pytest.raises(RuntimeError):
                stopped.take(part, n)
        store.take(part, n)
        if n in again:  # and once more after it was done
            store.take(part, n)
    return store


def test_families_that_meet_a_second_district(spark, tmp_path):
    rows = [(1, "R", "D1", "N", 1, 2, True), (2, "S", "D2", "N", 1, 2, True), (3, "R", "unknown", "N", 2, 2, True), (4, "S", "D1", "N", 2, 2, True), (5, "T", "D2", "N", 2, 2, True), (6, "R", "unknown", "N", 1, 2, True), (7, "T", "D1", "N", 1, 2, True)]
    store = in_batches(spark, f"{tmp_path}/a", rows, [1, 3, 4, 6, 8], again=(2,))
    got = store.assigned().collect()
    assert len(got) == len(rows) and {r.ingest_seq: r.slip_key for r in got} == plain(rows)
    state = {r.slip_key: (r.received, r.missing, r.status) for r in store.states().collect()}
    assert state["R"] == ([1, 2], [], "pending_review") and set(state) == set(plain(rows).values())


@pytest.mark.parametrize("seed", [2])
def test_random_arrivals_in_random_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = draw(rng, 300, *rng.choice([(5, 4), (60, 40)]))
    bounds = [0, *sorted(rng.sample(range(1, 300), 2)), 300]
    store = in_batches(spark, f"{tmp_path}/a", rows, bounds, again=(rng.randrange(3),))
    got = store.assigned().collect()
    assert len(got) == len(rows) and {r.ingest_seq: r.slip_key for r in got} == plain(rows)
    pages = {}
    for seq, key in plain(rows).items():
        pages.setdefault(key, set()).add(rows[seq][4])
    assert {r.slip_key: set(r.received) for r in store.states().collect()} == pages


def test_components_that_join_one_after_another(spark, tmp_path):
    """Names lead from one to the next; pages of families and districts that weren't seen since still find their slips."""
    links = [("R4", "D4"), ("R3", "D3"), ("R2", "D2"), ("R3", "D4"), ("R1", "D1"), ("R2", "D3"), ("R1", "D2"), ("R4", "D4"), ("R5", "D4"), ("R1", "D1"), ("R6", None), ("R6", "D3")]
    rows = [(i, ref, district, "N", 1 + i % 3, 3, i % 5 != 4) for i, (ref, district) in enumerate(links)]
    store = in_batches(spark, f"{tmp_path}/a", rows, [0, 3, 4, 6, 7, 9, 10, 12], again=(3,))
    assert {r.ingest_seq: r.slip_key for r in store.assigned().collect()} == plain(rows)
    held = store._read("folded", assign.FOLDED, range(4))
    assert held.select("comp").distinct().count() == 1 and {r.slip_key for r in store.states().collect()} == set(plain(rows).values())


def test_a_batch_of_known_families_writes_what_it_changes(spark, tmp_path):
    rows = [(i, f"R{i % 10}", f"D{i % 5}", "N", 1 + i // 10, 4, True) for i in range(40)]
    d, store, jobs = spark.createDataFrame(rows, schemas.PAGE_RECORDS), arrivals.Arrivals(spark, f"{tmp_path}/a", buckets=4), []
    for n in range(4):
        spark.sparkContext.setJobGroup(f"batch {n} {tmp_path}", "")
        store.take(d.where((F.col("ingest_seq") >= 10 * n) & (F.col("ingest_seq") < 10 * n + 10)), n)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {n} {tmp_path}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert {r.ingest_seq: r.slip_key for r in store.assigned().collect()} == plain(rows)
    assert {b for (table, _), b in store.log.items() if table == "nodes"} == {0} and max(jobs) < 40


def test_errors_and_affected_slips(spark, tmp_path):
    rows = [(1, "A", "V", "N", 1, 2, True, "x", None), (2, "A", "V", "N", 2, 2, True, "x", "unreadable"), (3, "A", "V", "N", 2, 2, True, "x", None), (4, "B", "W", "N", 1, 1, True, "y", None), (5, "B", "W", "N", 1, 1, True, "x", None), (6, "C", "V", "N", 2, 3, True, "z", None)]
    d = spark.createDataFrame(rows, f"{schemas.PAGE_RECORDS}, request_id string, error string")
    seen = []

    def evaluate(slips):
        seen.append({r.slip_key for r in slips.collect()})
        return slips.select("slip_key", F.size("missing").alias("lacking"))

    store = arrivals.Arrivals(spark, f"{tmp_path}/a", 4, evaluate)
    store.take(d.where("ingest_seq <= 4"), 0)
    store.take(d.where("ingest_seq > 4"), 1)
    assert {r.ingest_seq: r.slip_key for r in store.assigned().collect()} == {1: "A", 4: "B", 6: "A"}
    assert seen == [{"A", "B"}, {"A"}]
    assert sorted(map(tuple, store.results().collect())) == [("A", 1), ("A", 1), ("B", 0)]
    told = store.events()
    assert {r.request_id: r.outcome for r in progress.outcomes(told).collect()} == {"x": "error", "y": "aborted", "z": "aborted"}
    times = spark.createDataFrame([("x", "2024-01-01 00:00:00", "2024-01-01 00:00:03"), ("y", "2024-01-01 00:00:00", "2024-01-01 00:00:01"), ("q", None, None)], "request_id string, started_at string, ended_at string")
    got = {r.request_id: (r.processed_pages_count, r.affected_slips, r.average_per_page_seconds, r.outcome) for r in arrivals.upload_summary(told, times).collect()}
    assert got == {"x": (1, ["A"], 3.0, "error"), "y": (1, ["B"], 1.0, "complete"), "q": (0, [], None, "complete")}


def test_an_empty_batch(spark, tmp_path):
    store = in_batches(spark, f"{tmp_path}/a", [(1, "A", "V", "N", 1, 1, True)], [0, 1, 2, 3])
    assert [tuple(r) for r in store.assigned().collect()] == [(1, "A")]
