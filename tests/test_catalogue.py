"""Every catalogue query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from wordloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    names = sorted(df.columns)
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return names, sorted((tuple(map(value, r)) for r in df[names].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    assert plain(catalogue.QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
