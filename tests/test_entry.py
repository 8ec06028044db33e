"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from spindrel.queries import QUERIES, oracle_sql

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wrong = []
    for name, sql in oracle_sql().items():
        got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        same = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)  # noqa: B023, E731
        if columns != sorted(want.columns) or not same(got).equals(same(want)):
            wrong.append(name)
    assert wrong == []
