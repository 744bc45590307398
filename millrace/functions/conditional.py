"""Conditional columns and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import with_row, with_scalars
from ..operators.quantiles import quantiles
from ..operators.rows import predicate


def _value(v) -> Column:
    """A number if the text is one."""
    try:
        return F.lit(float(v))
    except (TypeError, ValueError):
        return F.lit(v)


def if_else(col: str, op: str, value, yes, no) -> Column:
    """A null cell takes no, but for "!="."""
    return F.when(predicate(col, op, value), _value(yes)).otherwise(_value(no))


def rules(cases: list[tuple[str, str, object, object]], default) -> Column:
    """(column, operator, value, label) in order; the first that holds gives the label."""
    labels = [c[3] for c in cases] + [default]
    try:
        lits = [F.lit(float(v)) for v in labels]
    except (TypeError, ValueError):
        lits = [F.lit(str(v)) for v in labels]
    out = lits[-1]
    for (col, op, value, _), lit in reversed(list(zip(cases, lits, strict=False))):
        out = F.when(predicate(col, op, value), lit).otherwise(out)
    return out


def equal_width(df: DataFrame, col: str, bins: int, name: str, labels: bool = False) -> DataFrame:
    """Bin of equal width from 0, closed on the right, the first one with the least value; labels are ranges."""
    df = with_scalars(df, __lo=F.min(col).cast("double"), __hi=F.max(col).cast("double"))
    lo, step = F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins
    out = F.lit(None).cast("string" if labels else "int")
    for i in reversed(range(bins)):
        edge = F.col("__hi") if i == bins - 1 else lo + step * (i + 1)
        label = F.concat(F.format_number(lo + step * i, "0.00"), F.lit("–"), F.format_number(edge, "0.00")) if labels else F.lit(i)
        out = F.when(F.col(col) <= edge, label).otherwise(out)
    return df.withColumn(name, F.when(F.col(col).isNotNull(), out)).drop("__lo", "__hi")


def equal_frequency(df: DataFrame, col: str, bins: int, name: str) -> DataFrame:
    """Bin between quantiles from 0, closed on the right; equal edges are one."""
    edges = quantiles(df, [col], [i / bins for i in range(bins + 1)]).agg(F.array_distinct(F.first("q")).alias("__e"))
    df = with_row(df, edges)
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(col))))).drop("__e")


def custom_bins(col: str, edges: list[float], labels: list[str] | None = None) -> Column:
    """Bin by edges, closed on the right, the first one closed on both sides; null outside."""
    edges, c = sorted(set(edges)), F.col(col)
    out = F.lit(None).cast("string" if labels else "int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when(c <= edges[i + 1], F.lit(labels[i] if labels else i)).otherwise(out)
    return F.when((c >= edges[0]) & (c <= edges[-1]), out)
