"""Every query that has SQL against DuckDB on the same tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from gleaner.plans import base

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    v = float(v)
    return 0.0 if v == 0 else float(f"{v:.9g}")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query(spark, sf_dir, duck, name):
    got = base.QUERIES[name](spark, sf_dir)
    r = duck.execute(base.SQL[name])
    columns = [d[0] for d in r.description]
    want = rows(columns, r.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(x) for x in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert base.QUERIES[name](spark, sf_dir).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
