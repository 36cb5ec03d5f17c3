"""Every registered query that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    want = duck.execute(SQL[name]).df()
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want) == len(got)
    keys = [c for c in columns if got[c].dtype.kind != "f"] + [c for c in columns if got[c].dtype.kind == "f"]
    order = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(keys, key=lambda c: c.map(str), ignore_index=True)
    want, got = order(want), order(got)
    for c in columns:
        assert all(a == b or abs(a - b) <= 2e-6 * max(1, abs(a)) for a, b in zip(want[c], got[c], strict=True) if a is not None or b is not None), c


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
