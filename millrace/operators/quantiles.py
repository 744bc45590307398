"""Exact linear quantiles of many columns and groups by bracketed selection, and modes.

Wanted are values by their place in the order of a column (of a group). A mergeable sketch of each column names two of its
values that a wanted place most likely lies between; one aggregate counts the values below, at and between these, which
says where the place really is. It is one of the named values, or lies between two: then only the values between those are
looked at further, by another sketch, until they are at most BOUND, which are ordered. So no more than BOUND values are in
one task, nothing is shuffled but sketches, counts and these few values, and a bad guess of the sketch costs a turn, no
exactness. Interpolation is numpy's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

#: Values that are ordered in one task at most; the sketch's size, the quantiles that it is asked for, and how many of these
#: lie between a bracket's ends and the place: as far off as such a sketch hardly ever is.
BOUND, SKETCH, GRID, SLACK = 1 << 18, 4096, 1024, 3
#: Rows up to which a table of brackets is broadcast.
FEW_BRACKETS = 20_000


def _long(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """by..., __c (number of the column), __v: the values of cols as double, neither null nor NaN, of rows that have every by."""
    kept = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"__{i}") for i, c in enumerate(cols)])
    kept = kept.na.drop(subset=by) if by else kept
    if len(cols) == 1:
        out = kept.select(*by, F.lit(0).alias("__c"), F.col("__0").alias("__v"))
    else:
        out = kept.select(*by, F.posexplode(F.array(*[f"__{i}" for i in range(len(cols))])).alias("__c", "__v"))
    return out.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))


def _sent(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= FEW_BRACKETS else small


def _ordered(values: DataFrame, keys: list[str], want: DataFrame, rows: int) -> DataFrame:
    """keys..., __r, __v: the value at each wanted place of each key, which has BOUND values at most."""
    counts = values.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    at = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v")))
    met = at.join(_sent(want.select(*keys, "__want"), rows), keys).withColumn("__r", F.filter("__want", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n"))))
    return met.select(*keys, F.explode("__r").alias("__r"), "__v")


# Expressions of many numbers are made as text: that is one call to the JVM, not one for each.


def _code(limits: list[str], v: str) -> Column:
    """2 i between the limits before and at i, 2 i + 1 at limit i; limits ascend, with nulls at the end."""
    return F.expr(" + ".join(["0", *(f"if({v} > {t}, 1, 0) + if({v} >= {t}, 1, 0)" for t in limits)]))


def _number(x: float | None) -> str:
    return "cast(null as double)" if x is None else f"double('{x!r}')"


def _grid(v: str) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double({v}, {SKETCH}), array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))}))")


def _selected(values: DataFrame, keys: list[str], want: DataFrame, turn: int = 0) -> DataFrame:
    """keys..., __r, __v for want(keys..., __n, __want): a key's number of values, and the places wanted, in an array."""
    most = want.agg(F.max("__n").alias("n"), F.count("*").alias("rows"), F.max(F.size("__want")).alias("places")).first()
    if (most["n"] or 0) <= BOUND:
        return _ordered(values, keys, want, most["rows"])
    n = F.col("__n")
    sketches = values.groupBy(*keys).agg(_grid("__v").alias("__s")).join(want.filter(n > BOUND), keys)
    near = lambda i: F.get("__s", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int"))
    ends = F.flatten(F.transform("__want", lambda r: F.array(near(F.floor(r * GRID / n) - SLACK), near(F.ceil((r + 1) * GRID / n) + SLACK))))
    limits = settle(sketches.select(*keys, F.array_sort(F.array_distinct(ends)).alias("__l")))
    spread = limits.select(*keys, *[F.get("__l", F.lit(i)).alias(f"__l{i}") for i in range(2 * most["places"])])
    code = f"__b{turn}"
    # Keys of few values have no limits, and are all in 0.
    coded = values.join(_sent(spread, most["rows"]), keys, "left").withColumn(code, _code([f"__l{i}" for i in range(2 * most["places"])], "__v"))
    counts = coded.groupBy(*keys, code).agg(F.count("*").alias("__n"))
    at = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy(code)))
    inside = lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n"))
    met = at.join(want.select(*keys, "__want"), keys).join(limits, keys, "left").withColumn("__want", F.filter("__want", inside)).filter(F.size("__want") > 0)
    met = settle(met.select(*keys, code, "__n", "__want", (F.col("__upto") - F.col("__n")).alias("__before"), F.when(F.col(code) % 2 == 1, F.get("__l", F.floor(F.col(code) / 2).cast("int"))).alias("__v")))
    found = met.filter(F.col(code) % 2 == 1).select(*keys, F.explode("__want").alias("__r"), "__v")
    left = met.filter(F.col(code) % 2 == 0).select(*keys, code, "__n", F.transform("__want", lambda r: r - F.col("__before")).alias("__want"), "__before")
    rows = left.count()
    if not rows:
        return found
    between = coded.select(*keys, code, "__v").join(_sent(left.select(*keys, code), rows), [*keys, code], "left_semi")
    more = _selected(between, [*keys, code], left.drop("__before"), turn + 1).join(_sent(left.select(*keys, code, "__before"), rows), [*keys, code])
    return found.unionByName(more.select(*keys, (F.col("__r") + F.col("__before")).alias("__r"), "__v"))


def _places(n: int, ps: list[float]) -> list[int]:
    return sorted({int(f(p * (n - 1))) for p in ps for f in (math.floor, math.ceil)})


def _whole(df: DataFrame, cols: list[str], ps: list[float]) -> list[tuple[int, dict[int, float]]]:
    """For each of cols the number of its values, and the value at each wanted place.

    What is known of a column are a few numbers a place, so the brackets are kept here and go into expressions.
    """
    wide = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"__{i}") for i, c in enumerate(cols)])
    each = lambda opens: wide.select(F.expr(f"posexplode(array({', '.join(o.text() for o in opens)}))").alias("k", "v")).filter("v is not null")
    counts, found = [0] * len(cols), [{} for _ in cols]
    open_, few = [_Open(i) for i in range(len(cols))], []
    while open_:
        brackets = []
        for r in each(open_).groupBy("k").agg(F.count("*").alias("n"), _grid("v").alias("s")).collect():
            o = open_[r["k"]]
            if o.places is None:
                counts[o.col], o.places = r["n"], _places(r["n"], ps)
            if r["n"] <= BOUND:
                few.append(o)
                continue
            near = lambda i, s=r["s"]: s[max(0, min(GRID, i))]
            ends = {near(i) for x in o.places for i in (x - o.before, x - o.before + 1) for i in (math.floor(i * GRID / r["n"]) - SLACK, math.ceil(i * GRID / r["n"]) + SLACK)}
            brackets.append((o, sorted(ends)))
        met = [{} for _ in brackets]
        limits = [f"array({', '.join(_number(e[i] if i < len(e) else None) for _, e in brackets)})[k]" for i in range(max([len(e) for _, e in brackets], default=0))]
        for r in each([o for o, _ in brackets]).groupBy("k", _code(limits, "v").alias("c")).count().collect() if brackets else ():
            met[r["k"]][r["c"]] = r["count"]
        open_ = []
        for (o, ends), n in zip(brackets, met, strict=True):
            before = o.before
            for code in sorted(n):
                here = [x for x in o.places if before <= x < before + n[code]]
                if here and code % 2:
                    found[o.col] |= dict.fromkeys(here, ends[code // 2])
                elif here:
                    low, high = ends[code // 2 - 1] if code else o.low, ends[code // 2] if code < 2 * len(ends) else o.high
                    (few if n[code] <= BOUND else open_).append(_Open(o.col, low, high, before, here))
                before += n[code]
    if few:
        up = each(few).groupBy("k", "v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
        wanted = F.expr(f"array({', '.join('array(' + ', '.join(f'{x - o.before}L' for x in o.places) + ')' for o in few)})[k]")
        for r in up.select("k", "v", F.filter(wanted, lambda x: (x < F.col("upto")) & (x >= F.col("upto") - F.col("n"))).alias("at")).filter(F.size("at") > 0).collect():
            found[few[r["k"]].col] |= {few[r["k"]].before + x: r["v"] for x in r["at"]}
    return list(zip(counts, found, strict=True))


@dataclass
class _Open:
    """Values of a column strictly between low and high, with how many are before them, and the wanted places among them."""

    col: int
    low: float | None = None
    high: float | None = None
    before: int = 0
    places: list[int] | None = None

    def text(self) -> str:
        tests = [f"__{self.col} {op} {_number(x)}" for op, x in ((">", self.low), ("<", self.high)) if x is not None]
        return f"if({' and '.join(tests)}, __{self.col}, null)" if tests else f"__{self.col}"


def quantiles(df: DataFrame, cols: list[str], ps: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., column_name, q (array of double, one for each of ps): exact linear quantiles of the values of each of cols.

    Nulls and NaN are no values. Groups are the non-null values of by. A column (of a group) without values has no row.
    """
    if not by:
        rows = []
        for c, (n, at) in zip(cols, _whole(df, cols, ps), strict=True):
            t = [p * (n - 1) for p in ps]
            if n:
                rows.append((c, [_linear(at[math.floor(x)], at[math.ceil(x)], x - math.floor(x)) for x in t]))
        return df.sparkSession.createDataFrame(rows, "column_name string, q array<double>")
    keys = [*by, "__c"]
    values = _long(df, cols, by)
    pos = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(pos(p)).cast("long"), F.ceil(pos(p)).cast("long")) for p in ps])))
    want = settle(values.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__want", places))
    at = _selected(values, keys, want)
    found = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m")).join(want, keys)

    def linear(p: float) -> Column:
        low, high = (F.element_at("__m", f(pos(p)).cast("long")) for f in (F.floor, F.ceil))
        t = pos(p) - F.floor(pos(p))
        return F.when(low == high, low).when(t < 0.5, low + (high - low) * t).otherwise(high - (high - low) * (1 - t))

    name = F.array(*map(F.lit, cols))[F.col("__c")]
    return found.select(*by, name.alias("column_name"), F.array(*map(linear, ps)).alias("q"))


def _linear(low: float, high: float, t: float) -> float:
    if low == high:
        return low
    return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)


def scalars(df: DataFrame, col: str, **ps: float) -> DataFrame:
    """One row with a quantile of col for each name, null without values."""
    q = quantiles(df, [col], list(ps.values())).agg(F.first("q").alias("q"))
    return q.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(ps)])


def mode(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row with the least of the most frequent non-null values of col; null without values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    return counts.agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))).alias("m")).select(F.col("m.v").alias(name))
