import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted((repr([fix(r[k]) for k in order]) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in SQL:
        got = db.execute(SQL[name])
        assert sorted(df.columns) == sorted(c[0] for c in got.description)
        columns = [c[0] for c in got.description]
        assert plain(rows, df.columns) == plain(got.fetchall(), columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES) and len([n for n in CORE if n in SQL]) >= 60
