"""Queries that SQL can express, against their SQL on a small table."""

import os
from collections import Counter

import pytest
from tiffinlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    order = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(order) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(cursor.fetchall())
