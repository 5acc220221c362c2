"""Every registered query against the SQL that says the same in another way."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from fixtures.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= driver.queries().keys() and SQL.keys() <= driver.oracle_sql().keys()


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) % 26 == 0 and rows


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    other = duck.execute(SQL[name])
    columns = sorted(c[0] for c in other.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in other.description].index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in other.fetchall())
