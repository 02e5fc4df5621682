import duckdb
import pytest

from tallyweave.plans import catalogue

D = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    q = duck.execute(catalogue.oracle_sql()[name])
    assert [c[0] for c in q.description] == df.columns
    assert plain(map(tuple, df.collect())) == plain(q.fetchall())


@pytest.mark.parametrize("name", ["page_assignment", "digit_fusion", "nested_detail_json", "command_log_state", "stage_progress"])
def test_rows(spark, name):
    assert catalogue.queries()[name](spark, D).count() > 0
