"""Every registered query outside the llm subpackage against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from codequarry import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return int(x) if hasattr(x, "__int__") and not isinstance(x, str) and not hasattr(x, "year") else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.count() > 0 and out.columns


def test_numbers_of_names():
    assert len(QUERIES) > 150
    assert not math.isnan(len(SQL))
