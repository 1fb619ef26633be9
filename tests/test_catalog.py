"""Every query against its SQL in DuckDB over the same tables."""

import os

import duckdb
import pytest

from quillstone.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_repeats_itself(spark, name):
    one, two = ([tuple(r) for r in catalog.queries()[name](spark, DATA).collect()] for _ in range(2))
    assert one and sorted(one, key=repr) == sorted(two, key=repr)
