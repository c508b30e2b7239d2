"""Queries of the subpackage that SQL can say, against DuckDB on the same tables."""

import duckdb
import pytest

from gleaner.llm import queries

from ..test_oracle import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    r = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(x) for x in got.collect()]) == rows(columns, r.fetchall())
