"""Every query of the catalogue against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tessera.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, decimal.Decimal):
        return format(x, "f")
    return repr(round(x, 5) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    assert sorted([plain(r[c]) for c in sorted(names)] for r in rows) == want
