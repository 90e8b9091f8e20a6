"""Every catalog query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from thicket.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer pages"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, row)) for row in found.fetchall()]
    assert columns == sorted(names)
    key = lambda row: tuple(str(row[c]) for c in columns)
    assert Counter(key(r.asDict()) for r in frame.collect()) == Counter(map(key, want))
