"""Registered queries against their SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from phrasepivot import file_queries, queries, training_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = queries.QUERIES | file_queries.QUERIES | training_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | file_queries.ORACLE_SQL | training_queries.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and rows
