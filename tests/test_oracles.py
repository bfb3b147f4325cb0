"""Every query against its SQL."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(wide):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{wide}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.6g}" if abs(x) < 1e5 else f"{x:.10g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(list(x)) if isinstance(x, (list, tuple)) else str(x)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


ALL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in ALL if n in catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, wide, name):
    found = duck.execute(ALL[name])
    expected = normal([d[0] for d in found.description], found.fetchall())
    df = entry.queries()[name](spark, wide)
    got = normal(df.columns, df.collect())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
    assert got[1], "an empty result shows nothing"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(ALL)))
def test_query_without_sql_runs(spark, wide, name):
    assert entry.queries()[name](spark, wide).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
