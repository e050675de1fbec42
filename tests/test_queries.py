"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from workload import registry

def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(str(r[n]) for n in order) for r in rows)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 10


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "events", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())
