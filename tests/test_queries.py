"""All registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check import canonical

QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()
REFERENCE = {name: fn for name, fn in QUERIES.items() if fn.__module__ == "checks.queries"}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(REFERENCE) <= set(SQL)


@pytest.mark.parametrize("name", sorted(REFERENCE))
def test_query(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = canonical(got), canonical(want)
    assert len(got) == len(want)
    assert got.equals(want)


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 1
