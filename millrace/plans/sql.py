"""The SQL editor: a table as the view data, any query over it; and steps given as functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def query(df: DataFrame, text: str, view: str = "data", **more: DataFrame) -> DataFrame:
    """Spark SQL over the view (and more tables by name): joins, set operations, windows, CTEs.

    Other than in SQLite 7 / 2 is 3.5 (use div), LIKE minds case (use ilike), dates are dates and booleans booleans.
    """
    for name, t in {view: df, **more}.items():
        t.createOrReplaceTempView(name)
    return df.sparkSession.sql(text)


def apply(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step of one's own. Texts of code aren't executed."""
    out = step(df)
    if not isinstance(out, DataFrame):
        raise TypeError("a step returns a DataFrame")
    return out


def map_batches(df: DataFrame, step, schema: str) -> DataFrame:
    """A step on pandas batches, for what columns can't express."""
    return df.mapInPandas(lambda it: (step(b) for b in it), schema)
