"""The registry of queries: each with its twin in DuckDB's SQL, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.views import duck, register

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function of the tables by its name; views that the SQL names are put in front of it."""

    def put(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir)
            return f(spark.table)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return put
