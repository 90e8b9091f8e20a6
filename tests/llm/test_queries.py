"""The corpus queries that SQL can express, against DuckDB over the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from thicket.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_planted_links_are_there():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    linked, joined = con.execute(f"SELECT count(*) FILTER (n_links > 0), count(*) FILTER (NOT kept) FROM ({queries.oracle_sql()['planted_near_vectors']})").fetchone()
    assert linked > 50 and joined > 30


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = queries.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    want = Counter(tuple(str(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())
    assert Counter(tuple(str(r[c]) for c in columns) for r in frame.collect()) == want and want
