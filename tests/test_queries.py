"""Registered queries against their SQL twins on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from memengine.queries import ORACLES

TABLES = "events documents embeddings pages benchmark labels conversations".split()
SLOW = ("stream_", "retrieval_loop", "vector_search", "result_quality", "reranked", "attachment_check", "answer_rows")
NAMES = [
    n for n in ORACLES if os.environ.get("MEMENGINE_ALL") or not n.startswith(SLOW)
]


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_rejects_are_of_all_items(spark, db):
    """All mail that the query rejected before its SQL was narrowed to pending videos is there, and the videos are too."""
    got = {r.memory_id for r in entry.queries()["enrichment_rejects"](spark, SMALL).collect()}
    mail = "SELECT sha256('gmail:d' || doc_id) FROM documents WHERE doc_id % 2 = 0 AND length(substring(text, 1, 60)) % 4 = 0"
    video = "SELECT sha256('youtube:' || lpad(doc_id::VARCHAR, 11, 'v')) FROM documents WHERE doc_id % 2 = 1 AND doc_id % 7 = 3 AND length(substring(text, 1, 60)) % 4 = 0"
    want = {r[0] for sql in (mail, video) for r in db.execute(sql).fetchall()}
    assert want and want <= got
