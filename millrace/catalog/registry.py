"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(t), where t(name) is a table, under its name; sql gives the same in DuckDB."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r(c, digits: int = 6):
    """A double rounded, as the SQL does, so that the order of summation doesn't show."""
    from pyspark.sql import functions as F

    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)
