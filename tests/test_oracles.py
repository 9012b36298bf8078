"""Every query that SQL can express gives what the SQL gives, names and types included."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillon import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


#: Queries of many small steps, a minute each here: left to runs of every query.
LONG = {"g5_louvain_rounds_facts", "r3_randomized_finds_the_leading"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - LONG))
def test_query_equals_its_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    relation = con.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(k, kinds[c]) for c, k in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert mine == theirs


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
