"""Queries that SQL can express, against it."""

import os

import duckdb

from quillstone.llm import queries

DATA = "/root/testdata/sf0.01"


def test_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, DATA), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.select(*columns).fetchall())
