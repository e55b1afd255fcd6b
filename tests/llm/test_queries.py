"""The registered queries of this folder against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidewater.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    want = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
