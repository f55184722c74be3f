"""Every panel query against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from tidepanel.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("PANEL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()[:19]
    return str(value)


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in registry.TABLE.items() if text))
def test_query_matches_sql(spark, db, name):
    query, text = registry.TABLE[name]
    got = query(spark, DATA)
    want = db.sql(text)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    right = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert left == right


def test_rows_only_queries_run(spark):
    for query, text in registry.TABLE.values():
        if not text:
            assert query(spark, DATA).count() >= 1
