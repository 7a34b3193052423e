import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from vectorloom import queries as own

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_agrees_with_its_sql(spark, db, name):
    df = own.queries()[name](spark, str(DATA))
    cur = db.execute(own.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(own.queries().keys() - own.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    df = own.queries()[name](spark, str(DATA))
    assert df.count() == len(df.collect()) > 0 and len(df.select(df.columns[0]).collect()) == df.count()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert own.queries().keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
