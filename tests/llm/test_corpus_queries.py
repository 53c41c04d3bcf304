"""Registered queries of the corpus operators against their SQL on the smallest tables; brute force is in the other files."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check import canonical
from clickrank.llm import oracle, queries


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.REGISTERED]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.REGISTERED) | {"pipeline"} <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query(spark, small, duck, name):
    got, want = queries.REGISTERED[name](spark, small).toPandas(), duck.sql(oracle.STATEMENTS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))
