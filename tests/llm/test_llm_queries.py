"""The llm queries that SQL can say, against their twins on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SMALL
from memengine.llm.queries import ORACLES, QUERIES
from test_queries import TABLES, cell


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
