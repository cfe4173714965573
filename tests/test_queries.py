"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from seqloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(plans.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda table: sorted(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
