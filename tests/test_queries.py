"""Every query over version histories against its DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from stratalog.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
