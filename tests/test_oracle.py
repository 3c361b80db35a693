"""Every registered query against its statement in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from aphora.queries import QUERIES as REGISTERED
from tests.conftest import DATA

TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(DATA))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df):
    df = df[sorted(df.columns)]
    rows = [tuple(_plain(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


# Queries of the optional text operators are tested in their own folder.
QUERIES = {name: run for name, run in contract.queries().items() if name in REGISTERED}
STATEMENTS = {name: sql for name, sql in contract.oracle_sql().items() if name in REGISTERED}


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(STATEMENTS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert contract.entry(spark).count() == 150
