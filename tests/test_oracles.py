"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def told(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if hasattr(value, "__float__") else str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(told, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in DATA.iterdir():
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
