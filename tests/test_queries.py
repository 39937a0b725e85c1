"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cells(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert cells(got.select(*columns).collect()) == cells(duck.sql(f"SELECT {quoted} FROM want").fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[:2] == ["indicator_a", "indicator_b"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
