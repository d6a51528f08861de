"""The driver's contract, and the registered queries against their SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
SQL = sorted(k for k in entry.oracle_sql() if not k.startswith("op"))


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    f = lambda x: ("nan" if math.isnan(x) else round(x, 6) + 0.0) if isinstance(x, float) else x
    return sorted((tuple(f(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 250


@pytest.mark.parametrize("name", SQL)
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    want = oracle.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)
