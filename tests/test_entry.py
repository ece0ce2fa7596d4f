import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_and_columns_match_sql(spark, duck, name):
    df, r = entry.queries()[name](spark, D), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert df.count() == len(r.fetchall())
