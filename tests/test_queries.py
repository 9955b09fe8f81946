"""Every query with SQL gives what the SQL gives, on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    order = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    expected = sorted([tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cursor.fetchall()], key=repr)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
