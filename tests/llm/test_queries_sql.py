"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    return repr(round(x, 5)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    got = sorted([plain(r[c]) for c in sorted(names)] for r in df.collect())
    assert got == want
