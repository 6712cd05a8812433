"""Every query of the graph engine against DuckDB."""

import math
import os

import duckdb
import pytest

from trustweave.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[i]) for i in at) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(want.columns, want.fetchall())
