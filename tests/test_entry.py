"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from grainfield.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, views, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(views.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
