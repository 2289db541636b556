"""Every query that has SQL is compared with it on the smallest tables, value by value."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from junctura.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, FOLDER)
    want = sql.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_rows_only_queries(spark):
    merged = plans.q34(spark, FOLDER)
    assert merged.agg({"members": "sum"}).first()[0] == plans.shipped(spark, FOLDER).count()
    runs = plans.q36(spark, FOLDER)
    assert runs.filter("cost > first_cost").count() == 0
    chained = plans.q35(spark, FOLDER)
    assert chained.filter("lo > last").count() == 0 and chained.count() > 0
