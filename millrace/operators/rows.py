"""Filters, duplicates, sorting, sampling and set operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import NUMERIC, settle
from .ordered import ROW
from .quantiles import scalars

# What a cell of a total or summary row looks like.
TOTAL_CELL = r"(?i)^\s*(?:grand\s+)?(?:sub\s*)?totals?\s*$|^\s*all\s+totals?\s*$|^\s*sum\s*$|^\s*overall\s*$|\btotal\b|\bsubtotal\b|\bgrand\s+total\b"
# What the name of a total column looks like.
TOTAL_NAME = r"(?:^|[\s_\-/])total(?:$|[\s_\-/\d])|^total$|\btotal\b"

COMPARISONS = {"=": Column.__eq__, "==": Column.__eq__, ">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


def predicate(col: str | Column, op: str, value=None) -> Column:
    """A test that is true or false for every row: a null cell only meets "is null", "!=" and "not contains".

    contains is a case-insensitive regular expression on the cell as text.
    """
    c = F.col(col) if isinstance(col, str) else col
    if op in COMPARISONS:
        return F.coalesce(COMPARISONS[op](c, F.lit(value)), F.lit(False))
    if op == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if op in ("contains", "not contains"):
        has = F.coalesce(c.cast("string").rlike(f"(?i){value}"), F.lit(False))
        return has if op == "contains" else ~has
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    raise ValueError(f"no operator {op!r}")


def filter_rows(df: DataFrame, col: str, op: str, value=None, keep: bool = True) -> DataFrame:
    test = predicate(col, op, value)
    return df.filter(test if keep else ~test)


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def drop_null_in(df: DataFrame, *cols: str) -> DataFrame:
    return df.na.drop(subset=list(cols))


def is_total_row(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Does any text cell look like the label of a total?"""
    out = F.lit(False)
    for c in cols or [f.name for f in df.schema if not isinstance(f.dataType, NUMERIC)]:
        out = out | F.coalesce(F.trim(F.col(c).cast("string")).rlike(TOTAL_CELL), F.lit(False))
    return out


def drop_total_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.filter(~is_total_row(df, cols))


def total_columns(names: list[str]) -> list[str]:
    return [n for n in names if re.search(TOTAL_NAME, n.strip(), re.IGNORECASE)]


def values_then_iqr(df: DataFrame, col: str | None, values: list, num: str | None, k: float = 1.5) -> DataFrame:
    """The filter before a chart: values of one column, then the IQR fences of another (nulls go)."""
    if col:
        df = df.filter(F.col(col).isin(values))
    if num:
        q = scalars(df, num, __q1=0.25, __q3=0.75)
        iqr = F.col("__q3") - F.col("__q1")
        df = df.join(F.broadcast(q)).filter(F.col(num).between(F.col("__q1") - k * iqr, F.col("__q3") + k * iqr)).drop("__q1", "__q3")
    return df


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All rows that share their key with another row; counted by a shuffle of keys, joined back null-safely."""
    keys = cols or df.columns
    n = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(n[f"__k{i}"])
    return df.join(n, same, "left_semi")


def drop_duplicates(df: DataFrame, cols: list[str] | None = None, keep: str = "first", row: str = ROW) -> DataFrame:
    """keep "first", "last" (by row) or "none" of equal keys. Without a row column any one row of each key stays."""
    keys = cols or [c for c in df.columns if c != row]
    rest = [c for c in df.columns if c not in keys]
    if keep == "none":  # counted before they shuffle, so a hot key is one row a task
        one = df.groupBy(*keys).agg(F.count("*").alias("__n"), *([F.first(F.struct(*rest)).alias("__r")] if rest else [])).filter("__n = 1")
        return one.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])
    if row not in df.columns:
        return df.dropDuplicates(keys)
    pick = F.min_by if keep == "first" else F.max_by  # pre-aggregated: one row a key and task is shuffled
    return df.groupBy(*keys).agg(pick(F.struct(*rest), row).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def flag_duplicates(df: DataFrame, cols: list[str], order: str, name: str = "is_duplicate") -> DataFrame:
    """name is true for every row of a key but the first by order (null first); of rows that tie there, any one is the first.

    The first row of each key is pre-aggregated and joined back, so a hot key is no window partition.
    """
    own = settle(df.withColumn("__at", F.monotonically_increasing_id()))
    first = own.groupBy(*cols).agg(F.min(F.struct(F.col(order).isNotNull().alias("x"), F.col(order).alias("o"), F.col("__at"))).alias("__f"))
    first = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)], F.col("__f.__at").alias("__first"))
    same = F.lit(True)
    for i, c in enumerate(cols):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return own.join(first, same).withColumn(name, F.col("__at") != F.col("__first")).select(*df.columns, name)


def sort_rows(df: DataFrame, *cols: tuple[str, bool] | str, nulls: str = "last") -> DataFrame:
    """(column, ascending) pairs; nulls come last in either direction unless nulls="first"."""
    out = []
    for c in cols:
        name, up = (c, True) if isinstance(c, str) else c
        out.append(getattr(F, f"{'asc' if up else 'desc'}_nulls_{nulls}")(name))
    return df.orderBy(*out)


def mixed(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of an integer key that other engines can compute, too."""
    return F.pmod(F.pmod(key * 48271 + seed * 7919, F.lit(2147483647)) * 69621 + seed, F.lit(2147483647))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones whatever the partitions."""
    if n > LIMIT:
        return _places(df, df.sparkSession.range(1).select(F.lit(n).cast("long").alias("__k")), [], key, seed)
    return df.orderBy(mixed(F.col(key), seed), key).limit(n)


#: mixed() gives numbers below this. Up to LIMIT rows of a sample are brought to one task.
MIXED, LIMIT = 2147483647, 100_000


def _places(df: DataFrame, n: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """Rows of df of the n["__k"] least places, in each group by, in the fixed order of key. n: by..., __k.

    Keys are counted in 2^16 bins of that order; whole bins are taken as they are, and only rows of the one bin a group in
    which the last place falls are ordered, so neither a sample nor a group is one task.
    """
    bins = 1 << 16
    width = MIXED // bins + 1
    at = df.withColumn("__o", mixed(F.col(key), seed)).withColumn("__bin", F.floor(F.col("__o") / width).cast("int"))
    counts = at.groupBy(*by, "__bin").agg(F.count("*").alias("__c"))
    upto = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("__bin")) - F.col("__c"))  # bins rows a group
    upto = (upto.join(n, by) if by else upto.join(F.broadcast(n))).filter("__before < __k")
    met = at.join(upto.select(*by, "__bin", (F.col("__k") - F.col("__before")).alias("__left"), "__c"), [*by, "__bin"])
    whole = met.filter("__c <= __left").select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*by, "__bin").orderBy("__o", key))
    cut = met.filter("__c > __left").withColumn("__rn", rank).filter("__rn <= __left").select(*df.columns)
    return whole.unionByName(cut)


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """round(fraction * rows) rows."""
    n = df.agg(F.round(F.count("*") * F.lit(float(fraction))).cast("long").alias("__k"))
    return _places(df, n, [], key, seed)


def stratified_sample(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """About n rows, round(n / rows * class) of each class; rows without a class go."""
    df = df.filter(F.col(by).isNotNull())
    sizes = df.groupBy(by).agg(F.count("*").alias("__size"))
    all_ = sizes.agg(F.sum("__size").alias("__all"))
    take = sizes.join(F.broadcast(all_)).select(by, F.bround(F.col("__size") * F.lit(float(n)) / F.col("__all")).cast("long").alias("__k"))
    return _places(df, take, [by], key, seed).select(*df.columns)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def schema_changes(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    return {"added": [c for c in after.columns if c not in before.columns], "removed": [c for c in before.columns if c not in after.columns]}


def schema_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (added, removed), column_name and n: how many values a column that came, or went, has."""
    parts = [("added", after), ("removed", before)]
    out = None
    for change, df in parts:
        cols = schema_changes(before, after)[change]
        one = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("n")) for c in cols]).alias("x")) if cols else None
        rows = one.select(F.lit(change).alias("change"), F.explode("x").alias("x")).select("change", "x.*") if cols else df.sparkSession.createDataFrame([], "change string, column_name string, n long")
        out = rows if out is None else out.unionByName(rows)
    return out
