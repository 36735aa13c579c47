"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from inboxlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    rows = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in rows.collect()))) == sorted(map(str, cursor.fetchall()))
