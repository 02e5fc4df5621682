"""Stored tables change a partition at a time and hold what dictionaries hold."""

import os
import random

from tallyweave.operators import store

REC = f"slip_id string, page_id string, party_results {store.READ}"


def record(slip, page, votes):
    return (slip, page, None if votes is None else [(i, f"Party {i}", f"P{i}", v, 0.9, v, True, None) for i, v in enumerate(votes)])


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}


def test_a_replaced_page_rewrites_its_partition_only(spark, tmp_path):
    rng, table, want = random.Random(6), store.PartyTable(spark, f"{tmp_path}/p", 8), {}
    first = [record(f"s{i % 20}", f"p{i}", [rng.randrange(9) for _ in range(3)]) for i in range(60)]
    for s, p, rows in first:
        want[p] = (s, [r[3] for r in rows])
    table.put(spark.createDataFrame(first, REC))
    for page, votes in (("p7", [5]), ("p8", None), ("p70", [1, 2])):
        before = files(f"{tmp_path}/p")
        slip = want.get(page, ("s3", []))[0]
        touched = table.put(spark.createDataFrame([record(slip, page, votes)], REC))
        after = files(f"{tmp_path}/p")
        assert len(touched) == 1 and {d for d in after if after[d] != before.get(d)} <= {f"part={touched[0]}"}
        want[page] = (slip, votes or [])
    got = {}
    for r in table.rows().orderBy("page_id", "row_index").collect():
        got.setdefault(r.page_id, (r.slip_id, []))[1].append(r.votes)
    assert got == {p: v for p, v in want.items() if v[1]}
    one = table.of_slip("s7")
    assert {r.page_id for r in one.collect()} == {p for p, v in want.items() if v[0] == "s7" and v[1]}
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
    table.put(spark.createDataFrame([record("s7", p, None) for p, v in want.items() if v[0] == "s7"], REC))
    assert table.of_slip("s7").count() == 0


def test_slips_by_status(spark, tmp_path):
    table = store.SlipTable(spark, f"{tmp_path}/s", "id string, votes int, status string")
    make = lambda rows: spark.createDataFrame(rows, "id string, votes int, status string")
    assert table.of_status("approved").count() == 0
    table.put(make([("a", 1, "incomplete"), ("b", 2, "approved"), ("c", 3, "flagged")]))
    before = files(f"{tmp_path}/s")
    assert table.put(make([("a", 4, "approved"), ("d", 5, "approved")])) == ["approved", "incomplete"]
    assert files(f"{tmp_path}/s")["status=flagged"] == before["status=flagged"] and "status=incomplete" not in files(f"{tmp_path}/s")
    approved = table.of_status("approved")
    assert sorted(tuple(r) for r in approved.collect()) == [("a", 4, "approved"), ("b", 2, "approved"), ("d", 5, "approved")]
    plan = approved._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    table.put(make([("a", 4, "approved"), ("d", 5, "approved")]))  # once more, as after a lost driver
    assert table.of_status("approved", "flagged").count() == 4


def test_seed_overwrites(spark):
    t = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, n int, own string")
    seed = spark.createDataFrame([("B", 9, "seed"), ("C", 8, "seed")], "k string, n int, own string")
    assert sorted(tuple(r) for r in store.seeded_over(t, seed, "k", ["n"]).collect()) == [("A", 1, "x"), ("B", 9, "y"), ("C", 8, "seed")]
    assert store.party_rows(spark.createDataFrame([], REC)).count() == 0
