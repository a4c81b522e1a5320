"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import DATA
from tools.check import TABLES, plain

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
