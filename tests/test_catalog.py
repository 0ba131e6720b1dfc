"""Every query that has SQL gives the same rows as DuckDB; the others run and keep their schema."""

import duckdb
import pytest

from siftworks.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    left = sorted((tuple(r[df.columns.index(c)] for c in order) for r in rows), key=key)
    right = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=key)
    assert left == right


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
