"""Every registered query against its SQL counterpart in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from canopy.plans import QUERIES

DATA = os.environ.get("CANOPY_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="provided tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert got, "every query has rows on the provided tables"
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, got) == table(columns, result.fetchall())


def test_flagship_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["struct", "iface"]
