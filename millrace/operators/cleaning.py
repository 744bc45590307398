"""Missing values, replacement and outliers.

Scalars that a treatment needs (a mean, fences) are one-row aggregates joined by broadcast; nothing is collected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import columns_of
from .ordered import counted
from .quantiles import mode, quantiles, scalars

# Tokens that stand for a missing value.
NULL_TOKENS = ["-", "NA", "N/A", "null", "NULL", ""]


def tokens_to_null(df: DataFrame, tokens: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(tokens or NULL_TOKENS), F.col(c)) for c in cols})


def with_scalars(df: DataFrame, **what: Column) -> DataFrame:
    """df with aggregates of itself as columns: one row, so always broadcast."""
    return with_row(df, df.agg(*[c.alias(n) for n, c in what.items()]))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.join(F.broadcast(one))


def fill_missing(df: DataFrame, col: str, how: str = "mean", value=None) -> DataFrame:
    """how: mean, median, mode (the least of the most frequent) or constant."""
    if how == "constant":
        return df.withColumn(col, F.coalesce(col, F.lit(value)))
    one = {"mean": lambda: df.agg(F.avg(col).alias("__s")), "median": lambda: scalars(df, col, __s=0.5), "mode": lambda: mode(df, col, "__s")}[how]()
    return with_row(df, one).withColumn(col, F.coalesce(col, "__s")).drop("__s")


def fill_missing_by(df: DataFrame, col: str, by: str, how: str = "mean") -> DataFrame:
    """The statistic of the row's group; rows without a group, and groups without values, stay."""
    if how == "mode":
        n = df.filter(F.col(col).isNotNull() & F.col(by).isNotNull()).groupBy(by, col).agg(F.count("*").alias("__n"))
        stat = n.groupBy(by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v"))).alias("__m")).select(F.col(by).alias("__k"), F.col("__m.v").alias("__s"))
    elif how == "median":
        stat = _medians(df, col, by)
    else:
        stat = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("__k")).agg(F.avg(col).alias("__s"))
    return df.join(stat, F.col(by) == F.col("__k"), "left").withColumn(col, F.coalesce(col, "__s")).drop("__k", "__s")


def _medians(df: DataFrame, col: str, by: str) -> DataFrame:
    return quantiles(df.select(by, col), [col], [0.5], [by]).select(F.col(by).alias("__k"), F.col("q")[0].alias("__s"))


def suggest_fills(df: DataFrame) -> DataFrame:
    """column_name, missing_pct, how for every column: what suggest_fill() says of its missing cells and its skewness."""
    from .statistics import missing_by_column, skewness

    num = columns_of(df, "numeric")
    skewed = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in num])).alias("i", "v")).groupBy("i").agg(skewness(F.col("v")).alias("s")).collect() if num else []  # a row a column
    skew = {num[r["i"]]: r["s"] for r in skewed}
    rows = [(r["column_name"], r["missing_pct"], suggest_fill(r["missing_pct"], skew.get(r["column_name"]), r["column_name"] in num)) for r in missing_by_column(df).collect()]
    return df.sparkSession.createDataFrame(rows, "column_name string, missing_pct double, how string")


def suggest_fill(missing_pct: float, skewness: float | None, numeric: bool) -> str:
    if missing_pct > 50:
        return "drop column"
    if missing_pct > 20:
        return "grouped fill or drop rows"
    if not numeric:
        return "mode"
    return "median" if missing_pct > 5 or abs(skewness or 0) > 1 else "mean"


def replace_cells(df: DataFrame, col: str, old, new) -> DataFrame:
    """Whole cells: numbers are compared as numbers. A blank new value is null."""
    numeric = dict(df.dtypes)[col] not in ("string",)
    try:
        value = F.lit(None) if new in ("", None) else F.lit(float(new) if numeric else str(new))
        test = F.col(col).cast("double") == float(old) if numeric else F.col(col) == str(old)
    except ValueError:
        numeric, value, test = False, F.lit(new), F.col(col).cast("string") == str(old)
    c = F.col(col).cast("double") if numeric else F.col(col).cast("string")
    return df.withColumn(col, F.when(test, value).otherwise(c))


def replace_text(df: DataFrame, col: str, old: str, new: str, regex: bool = False, case: bool = False) -> DataFrame:
    pattern = old if regex else re.escape(old)
    return df.withColumn(col, F.regexp_replace(F.col(col).cast("string"), ("" if case else "(?i)") + pattern, new if regex else new.replace("\\", "\\\\").replace("$", "\\$")))


def map_values(df: DataFrame, col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Exact replacement by a table; others stay. A repeated source value is an error."""
    if len({a for a, _ in pairs}) < len(pairs):
        raise ValueError("a value is mapped twice")
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    c = F.col(col).cast("string")
    return df.withColumn(col, F.coalesce(table[c], c))


def iqr_fences(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """One row: __lo and __hi, k quartile ranges below the first and above the third quartile."""
    q = scalars(df, col, q1=0.25, q3=0.75)
    return q.select((F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("__lo"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("__hi"))


def flag_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None, name: str = "is_outlier", lower=None, upper=None) -> DataFrame:
    """name: iqr (needs four values), zscore (sample deviation), zscore_pop (needs three), modified_z or bounds; nulls are none."""
    c = F.col(col)
    if method == "bounds":
        test = F.lit(False)
        test = test | (c < lower) if lower is not None else test
        test = test | (c > upper) if upper is not None else test
        return df.withColumn(name, F.coalesce(test, F.lit(False)))
    if method == "iqr":
        df = with_scalars(with_row(df, iqr_fences(df, col, threshold or 1.5)), __n=F.count(col))
        test = ((c < F.col("__lo")) | (c > F.col("__hi"))) & (F.col("__n") >= 4)
    elif method in ("zscore", "zscore_pop"):
        df = with_scalars(df, __m=F.avg(col), __s=(F.stddev_samp if method == "zscore" else F.stddev_pop)(col), __n=F.count(col))
        z = F.abs(F.try_divide(c - F.col("__m"), F.col("__s")))
        test = (z > (threshold or 3.0)) & (F.col("__n") >= (1 if method == "zscore" else 3))
    else:
        df = with_row(df, scalars(df, col, __m=0.5))
        df = with_row(df, scalars(df.select(F.abs(c - F.col("__m")).alias("v")), "v", __d=0.5))
        test = F.abs(0.6745 * F.try_divide(c - F.col("__m"), F.col("__d"))) > (threshold or 3.5)
    return df.withColumn(name, F.coalesce(test, F.lit(False))).drop("__lo", "__hi", "__n", "__m", "__s", "__d")


def drop_outliers(df: DataFrame, col: str, **kw) -> DataFrame:
    return flag_outliers(df, col, name="__out", **kw).filter("not __out").drop("__out")


def cap_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    df = with_row(df, iqr_fences(df, col, k))
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.least(F.col(col), "__hi"), "__lo"))).drop("__lo", "__hi")


def winsorize(df: DataFrame, col: str, low: float = 0.05, high: float = 0.05) -> DataFrame:
    """The int(low * n) least and int(high * n) greatest values become the nearest value that stays."""
    values = counted(df, col)
    at = with_row(values, values.agg(F.sum("__n").alias("n")))
    low_at, high_at = F.floor(F.col("n") * low) + 1, F.col("n") - F.floor(F.col("n") * high)  # places from 1
    holds = lambda place: (F.col("__upto") >= place) & (F.col("__upto") - F.col("__n") < place)
    met = at.filter(holds(low_at) | holds(high_at))
    ends = met.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    return df.join(F.broadcast(ends)).withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.least(F.col(col), "__hi"), "__lo"))).drop("__lo", "__hi")


def group_statistic(df: DataFrame, col: str, by: str, how: str, name: str | None = None) -> DataFrame:
    """mean, median, sum, min, max, std or count of col in the row's group, null for rows without a group.

    Groups are aggregated before they shuffle and joined back, so a hot group is no window partition.
    """
    if how == "median":
        stat = _medians(df, col, by)
    else:
        fs = {"mean": F.avg(col), "sum": F.coalesce(F.sum(col), F.lit(0)), "min": F.min(col), "max": F.max(col), "std": F.stddev_samp(col), "count": F.count(col)}
        stat = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("__k")).agg(fs[how].alias("__s"))
    return df.join(stat, F.col(by) == F.col("__k"), "left").withColumn(name or f"{col}_{how}_by_{by}", F.col("__s")).drop("__k", "__s")


