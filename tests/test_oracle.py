"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables (survey rows S1-X4, by query name)."""

import datetime
import decimal
import os

import duckdb
import pytest

from orrery import change_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
ALL, SQL = queries.QUERIES | change_queries.QUERIES, queries.SQL | change_queries.SQL


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows(spark, duck, name):
    df = ALL[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect()) == want
