"""Arithmetic over columns. Division by zero is null; ANSI mode never raises."""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import with_scalars


def binary(a: Column, b: Column, op: str) -> Column:
    """add, subtract, multiply, divide, power, max, min, mean; the last three skip nulls."""
    a, b = a.cast("double"), b.cast("double")
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    ops = {
        "add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: F.try_divide(a, b), "power": lambda: F.pow(a, b), "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b),
        "mean": lambda: F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), n),
    }
    return ops[op]()


def powers(col: str, degree: int) -> dict[str, Column]:
    return {f"{col}_pow{d}": F.pow(F.col(col), F.lit(float(d))) for d in range(2, degree + 1)}


def row_wise(cols: list[str], how: str) -> Column:
    """sum, mean, median, min, max, std (sample) or range of a row's non-null values."""
    v = [F.col(c).cast("double") for c in cols]
    plus = lambda xs: functools.reduce(lambda a, b: a + b, xs)
    n = plus([x.isNotNull().cast("int") for x in v])
    total = plus([F.coalesce(x, F.lit(0.0)) for x in v])
    mean = F.try_divide(total, n)
    if how in ("sum", "mean"):
        return total if how == "sum" else mean
    if how == "std":
        off = plus([F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in v])
        return F.when(n > 1, F.sqrt(off / (n - 1)))
    if how == "median":
        s = F.array_sort(F.array(*v))  # nulls are last
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    low, high = (F.least(*v), F.greatest(*v)) if len(v) > 1 else (v[0], v[0])  # both skip nulls
    return {"min": low, "max": high, "range": high - low}[how]


def interactions(cols: list[str], ops: tuple[str, ...] = ("multiply",)) -> dict[str, Column]:
    """Columns a_op_b for every two of cols."""
    return {f"{a}_{op}_{b}": binary(F.col(a), F.col(b), op) for a, b in combinations(cols, 2) for op in ops}


def scaled(df: DataFrame, col: str, how: str, name: str) -> DataFrame:
    """log (shifted to start at 1 if there are values of 0 or less), sqrt (shifted to 0 if negative), cbrt, reciprocal, min-max, z-score."""
    c = F.col(col).cast("double")
    if how == "cbrt":
        return df.withColumn(name, F.cbrt(c))
    if how == "reciprocal":
        return df.withColumn(name, F.try_divide(F.lit(1.0), c))
    df = with_scalars(df, __lo=F.min(c), __hi=F.max(c), __m=F.avg(c), __s=F.stddev_samp(c))
    lo = F.col("__lo")
    out = {
        "log": F.log1p(F.when(lo <= 0, c - lo + 1).otherwise(c)),
        "sqrt": F.sqrt(F.when(lo < 0, c - lo).otherwise(c)),
        "minmax": F.try_divide(c - lo, F.col("__hi") - lo),
        "zscore": F.try_divide(c - F.col("__m"), F.col("__s")),
    }[how]
    return df.withColumn(name, out).drop("__lo", "__hi", "__m", "__s")


#: Words that an expression may not have: it is one expression over columns, nothing that reads elsewhere.
_BANNED = ("select", "reflect", "java_method", "input_file", "assert_true", "raise_error")


def expression(text: str) -> Column:
    if any(w in text.lower() for w in _BANNED) or ";" in text:
        raise ValueError("not an expression over columns")
    return F.expr(text)
