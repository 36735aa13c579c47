"""Every registered query against its SQL, over the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from inboxlake import plans
from inboxlake.sources.derived import BASE_TABLES, DERIVATIONS, Inbox, ctes

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(DERIVATIONS))
def test_derived_table(spark, checker, name):
    ours = sorted(str([plain(v) for v in r]) for r in getattr(Inbox(spark, FOLDER), name).collect())
    theirs = sorted(str([plain(v) for v in r]) for r in checker.execute(f"with {ctes(name)} select * from {name}").fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, checker, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    cursor = checker.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
