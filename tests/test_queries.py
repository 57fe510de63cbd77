"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from sievestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str, datetime.date)):
        return str(v)
    return float(v) + 0.0


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in r])
    ours = order(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = order(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert all(close(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    row = catalogue.flagship(spark, SF).first()
    assert row["n_samples"] == 200 and 0 <= row["overall"] <= 100
