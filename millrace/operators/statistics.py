"""Profiles, correlations, associations and distributions.

Everything that reads rows is a grouped aggregate: a profile of many columns is one pass and one ordering for all
quantiles, ranks are taken over counted values, chi-square and Kendall's tau over counted pairs, densities over bins.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.result import HardStop
from ..session import columns_of, settle
from .ordered import counted, each_place, prefix_sums
from .quantiles import mode, quantiles
from .reshape import MOST_CELLS


def skewness(c: Column) -> Column:
    """Corrected for bias; null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((F.count(c) > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(c: Column) -> Column:
    """Excess, corrected for bias; null below four values or without spread."""
    n = F.count(c).cast("double")
    return F.when((F.count(c) > 3) & (F.stddev_pop(c) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def moments(c: Column) -> dict[str, Column]:
    return {
        "n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "missing_pct": F.avg(c.isNull().cast("double")) * 100,
        "zeros_pct": F.avg(F.coalesce((c == 0).cast("double"), F.lit(0.0))) * 100, "skewness": skewness(c), "kurtosis": kurtosis(c),
    }


def _long(df: DataFrame, cols: list[str], measures) -> DataFrame:
    """A row for each column, from one aggregate over all cells: one column's measures, so that they stay one compiled step."""
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("__c", "__v"))
    found = cells.groupBy("__c").agg(*[v.alias(k) for k, v in measures(F.col("__v")).items()])
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "__c int, column_name string")
    return names.join(found, "__c", "left").drop("__c")


def profile_numeric(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column. Quartiles are exact, and null without values; approximate ones need no ordering."""
    cols = cols or columns_of(df, "numeric")
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    if approximate:
        q = lambda c: F.percentile_approx(c, list(QUARTILES.values()), 100_000)
        return _long(d, cols, lambda c: moments(c) | {k: q(c)[i] for i, k in enumerate(QUARTILES)})
    at = quantiles(d, cols, list(QUARTILES.values())).select("column_name", *[F.col("q")[i].alias(k) for i, k in enumerate(QUARTILES)])
    return _long(d, cols, moments).join(F.broadcast(at), "column_name", "left")  # a row a column


def numeric_card(df: DataFrame, col: str) -> DataFrame:
    """The full card of one column: also mode (least of the most frequent), variance, range, IQR and CV."""
    own = df.select(F.col(col).cast("double").alias(col))
    card = profile_numeric(own, [col]).join(F.broadcast(mode(own, col, "mode")))
    c = F.col
    more = {"variance": c("std") * c("std"), "value_range": c("max") - c("min"), "iqr": c("q3") - c("q1"), "cv_pct": F.abs(F.try_divide("std", "mean")) * 100}
    return card.withColumns(more).drop("column_name")


def profile_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, n_unique, mode_value, mode_freq, mode_pct, missing, missing_pct.

    All columns are unpivoted and counted by (column, value), so a hot value is pre-aggregated.
    """
    cols = cols or columns_of(df, "categorical")
    kept = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = kept.select(F.lit(1).alias("one"), *cols).unpivot("one", cols, "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))
    out = counts.groupBy("column_name").agg(F.count("value").alias("n_unique"), top.alias("t"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("rows"))
    return out.select("column_name", "n_unique", F.col("t.value").alias("mode_value"), (-F.col("t.n")).alias("mode_freq"), (-F.col("t.n") * 100.0 / F.col("rows")).alias("mode_pct"), "missing", (F.col("missing") * 100.0 / F.col("rows")).alias("missing_pct"))


def datetime_card(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.agg(F.min(c).alias("first_ts"), F.max(c).alias("last_ts"), F.datediff(F.max(c), F.min(c)).cast("long").alias("range_days"), F.count_distinct(c).alias("n_unique"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """value, n and share, the most frequent first, ties by value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    out = counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("value", "n", (F.col("n") / F.col("__all")).alias("share")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def rare_values(df: DataFrame, col: str, share: float = 0.01) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * share)).alias("__t"))
    return counts.filter("value is not null").join(F.broadcast(total)).filter("n <= __t").select("value", "n")


def duplicate_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """n_rows, n_distinct, n_duplicates of the rows (or a subset of columns); nulls are equal to each other."""
    groups = df.groupBy(*(cols or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """column_name, missing, missing_pct, present and risk (critical from 20 %, medium from 5 %)."""
    one = df.agg(F.count("*").alias("n"), F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns]).alias("p"))
    out = one.select("n", F.posexplode("p").alias("i", "present"), F.array(*map(F.lit, df.columns)).alias("c")).select(F.col("c")[F.col("i")].alias("column_name"), (F.col("n") - F.col("present")).alias("missing"), "present")
    share = F.col("missing") / F.greatest(F.col("missing") + F.col("present"), F.lit(1))
    return out.select("column_name", "missing", "present", (share * 100).alias("missing_pct"), F.when(share >= 0.20, "critical").when(share >= 0.05, "medium").otherwise("none").alias("risk"))


def missing_by_row(df: DataFrame) -> DataFrame:
    """How many rows lack none, up to 25, 50, 75 % or more of their cells: band and n."""
    share = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) / len(df.columns)
    band = F.when(share <= 0, "complete").when(share <= 0.25, "to 25%").when(share <= 0.5, "to 50%").when(share <= 0.75, "to 75%").otherwise("over 75%")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def _pairs(cols: list[str], what) -> list[Column]:
    return [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), what(a, b).alias("r")) for a, b in combinations(cols, 2)]


def _exploded(df: DataFrame, pairs: list[Column]) -> DataFrame:
    one = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows that have both; null without spread."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """a, b, r for every two columns, over the rows that have both."""
    cols = cols or columns_of(df, "numeric")
    return _exploded(df, _pairs(cols, lambda a, b: _correlation(F.col(a).cast("double"), F.col(b).cast("double"))))


def _pair_counts(df: DataFrame, pairs: list[tuple[str, str]], kind: str = "double") -> DataFrame:
    """p (number of the pair), x, y, n: counted values of every pair, of rows that have both."""
    cell = lambda c: F.col(f"`{c}`").cast(kind)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), cell(a).alias("x"), cell(b).alias("y")) for i, (a, b) in enumerate(pairs)])).alias("e")
    return df.select(each).select("e.*").na.drop().groupBy("p", "x", "y").agg(F.count("*").alias("n"))


def _named(df: DataFrame, pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """a, b, value of a table with a row for each pair p; null for pairs without one."""
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "p int, a string, b string")
    return names.join(df.select("p", value), "p", "left").select("a", "b", value)


def spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """a, b, r for every two columns: Pearson's r of average ranks, over the rows that have both; null without spread.

    Each column is counted and ordered once, all of them together. A value's rank among the rows that also have another
    column is its rank in the column less those of the rows before, and half of its own, that lack the other one: these
    are counted and added up beside. Ranks are joined to the rows, a column at a time.
    """
    cols = cols or columns_of(df, "numeric")
    pairs = list(combinations(cols, 2))
    if not pairs:
        return _named(df.sparkSession.createDataFrame([], "p int, r double"), pairs, "r")
    rows = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(cols)])
    has = rows.agg(*[F.bool_or(F.col(f"v{i}").isNull()).alias(f"v{i}") for i in range(len(cols))]).first()
    gaps = [i for i in range(len(cols)) if has[f"v{i}"]]
    lacks = [F.col(f"v{i}").isNull().cast("long").alias(f"n{i}") for i in gaps]
    each = rows.select(*lacks, F.posexplode(F.array(*[f"v{i}" for i in range(len(cols))])).alias("c", "v")).filter("v is not null")
    sums = [f"n{i}" for i in gaps]
    counts = each.groupBy("c", "v").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in sums])
    at = prefix_sums(counts, ["c"], ["v"], ["n", *sums], ["b", *[f"b{i}" for i in gaps]])
    middle = lambda b, n, last: F.col(b) + (F.col(n) + last) / 2
    ranks = at.select("c", "v", middle("b", "n", 1).alias("r"), *[middle(f"b{i}", f"n{i}", 0).alias(f"less{i}") for i in gaps])
    for i in range(len(cols)):
        own = ranks.filter(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("r").alias(f"r{i}"), *[F.col(f"less{j}").alias(f"r{i}_{j}") for j in gaps if j != i])
        rows = rows.join(own, f"v{i}", "left")
    rank = lambda i, other: F.col(f"r{i}") - F.col(f"r{i}_{other}") if other in gaps else F.col(f"r{i}")
    r = [_correlation(rank(i, j), rank(j, i)).alias(f"p{k}") for k, (i, j) in enumerate(combinations(range(len(cols)), 2))]
    one = rows.agg(*r)
    return _named(one.select(F.posexplode(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("p", "r")), pairs, "r")


#: Counted pairs of values among which one task counts inversions; more are cut by quantiles, so few that a table of ranges is no more.
INVERSIONS = 1 << 19


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The sum of n * n over pairs with a smaller x and a larger y. By binary digits of y's rank: two ranks differ first in one."""
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order]
    w, total = n[order].astype(float), 0.0
    for d in reversed(range(int(rank.max(initial=0)).bit_length())):
        one = (rank >> d) & 1
        group = rank >> (d + 1)  # ranks that agree in higher digits stand together, in the order of x
        ones = np.cumsum(w * one)
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        before = (ones - w * one)[begins]
        total += float(((ones - np.repeat(before, np.diff(begins, append=len(w)))) * w)[one == 0].sum())
        order = np.argsort(rank >> d, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _discordant(cells: DataFrame) -> DataFrame:
    """p, disc: discordant pairs of cells(p, x, y, n).

    A table of more than INVERSIONS cells is cut by x and by y into ranges, each value that begins a range being one of its
    own. Pairs of cells in different ranges of both are told by the table of ranges, which is another table of cells; the
    others are in one range of x, or of y, or of both, where they would be counted twice. So a large table gives smaller
    ones, some of which count negatively, until each is counted in a task. A range of one value has no inversions.
    """
    cuts = max(2, math.isqrt(INVERSIONS) // 2)  # with the values that begin them at most twice as many
    rows, found = cells.select("p", F.lit("").alias("k"), F.lit(1).alias("s"), "x", "y", F.col("n").cast("long").alias("n")), None
    sizes = rows.groupBy("p", "k").agg(F.count("*").alias("size"))
    while (large := settle(sizes.filter(F.col("size") > INVERSIONS))) and not large.isEmpty():
        met = rows.join(large, ["p", "k"])
        grid = lambda v: F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double({v}, 4096), array({', '.join(f'{i / cuts!r}D' for i in range(1, cuts))}))")
        # Every m-th of the sketch's quantiles, so that a range has half as many cells as a task counts, where they suffice.
        every = F.greatest(F.lit(1), F.floor(F.lit(cuts * INVERSIONS / 2) / F.first("size"))).cast("int")
        ends = met.groupBy("p", "k").agg(grid("x").alias("ex"), grid("y").alias("ey"), every.alias("m"))
        thin = lambda e: F.array_sort(F.array_distinct(F.filter(e, lambda v, i: (i + 1) % F.col("m") == 0)))
        ends = settle(ends.select("p", "k", thin("ex").alias("ex"), thin("ey").alias("ey")))
        known = {(r["p"], r["k"]): (np.array(r["ex"]), np.array(r["ey"])) for r in ends.collect()}  # a few numbers for each large table

        def ranges(batches, known=known):
            for b in batches:
                t = b.to_pandas()
                for (p, k), own in t.groupby(["p", "k"], sort=False):
                    code = [np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right") for e, v in zip(known[p, k], (own["x"], own["y"]), strict=True)]
                    yield pa.RecordBatch.from_pandas(own.assign(i=code[0], j=code[1]), preserve_index=False)

        told = met.select("p", "k", "s", "x", "y", "n").mapInArrow(ranges, "p int, k string, s int, x double, y double, n long, i long, j long")
        c = F.col
        part = lambda kind, sign, *at: F.struct(F.concat("k", F.lit(f"/{kind}"), *[F.concat(F.lit("."), c(a)) for a in at]).alias("k"), (c("s") * sign).alias("s"))
        x_in, y_in = c("i") % 2 == 0, c("j") % 2 == 0
        parts = F.filter(F.array(F.when(x_in, part("x", 1, "i")), F.when(y_in, part("y", 1, "j")), F.when(x_in & y_in, part("b", -1, "i", "j"))), lambda e: e.isNotNull())
        split = told.select("p", F.explode(parts).alias("e"), "x", "y", "n").select("p", "e.k", "e.s", "x", "y", "n")
        coarse = told.groupBy("p", "k", "s", "i", "j").agg(F.sum("n").alias("n")).select("p", F.concat("k", F.lit("/t")).alias("k"), "s", c("i").cast("double").alias("x"), c("j").cast("double").alias("y"), "n")
        few = rows.join(large.select("p", "k"), ["p", "k"], "left_anti")
        found = few if found is None else found.unionByName(few)
        rows = settle(split.unionByName(coarse))
        sizes = rows.groupBy("p", "k").agg(F.count("*").alias("size"))
    rows = rows if found is None else found.unionByName(rows)

    def count(t: pa.Table) -> pa.Table:
        x, y, n = (t.column(c).to_numpy() for c in "xyn")
        return pa.table({"p": t.column("p")[:1], "d": [t.column("s")[0].as_py() * inversions(x, y, n)]})

    return rows.groupBy("p", "k").applyInArrow(count, "p int, d double").groupBy("p").agg(F.sum("d").alias("disc"))


def _tau_of(t: pa.Table) -> pa.Table:
    """p, r of a pair whose cells one task counts."""
    x, y, n = (t.column(c).to_numpy() for c in "xyn")
    half = lambda m: float((m.astype(float) * (m - 1)).sum()) / 2
    every = half(np.array([n.sum()]))
    tx, ty = (half(np.bincount(np.unique(v, return_inverse=True)[1], n)) for v in (x, y))
    square = (every - tx) * (every - ty)
    tau = (every - tx - ty + half(n) - 2 * inversions(x, y, n)) / math.sqrt(square) if square > 0 else None
    return pa.table({"p": t.column("p")[:1], "r": pa.array([tau], pa.float64())})


def kendall(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """a, b, r for every two columns: Kendall's tau-b over counted pairs of values, over the rows that have both; null without spread.

    Discordant pairs are inversions of y in the order of x: a pair's cells are counted in one task, or by ranges where they
    are more than INVERSIONS.
    """
    pairs = list(combinations(cols or columns_of(df, "numeric"), 2))
    cells = settle(_pair_counts(df, pairs))
    if all(r["n"] <= INVERSIONS for r in cells.groupBy("p").agg(F.count("*").alias("n")).collect()):  # a row a pair
        return _named(cells.groupBy("p").applyInArrow(_tau_of, "p int, r double"), pairs, "r")
    c = F.col
    half = lambda n: F.sum(n.cast("double") * (n - 1)) / 2
    ties = lambda key: cells.groupBy("p", key).agg(F.sum("n").alias("n")).groupBy("p").agg(half(c("n")).alias(f"t{key}"))
    one = cells.groupBy("p").agg((F.sum("n").cast("double") * (F.sum("n") - 1) / 2).alias("all"), half(c("n")).alias("txy"))
    one = one.join(ties("x"), "p").join(ties("y"), "p").join(_discordant(cells), "p")
    score = c("all") - c("tx") - c("ty") + c("txy") - 2 * c("disc")
    tau = F.try_divide(score, F.sqrt((c("all") - c("tx")) * (c("all") - c("ty"))))
    return _named(one.select("p", tau.alias("r")), pairs, "r")


def correlations(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """a, b, r for every two columns by pearson, spearman or kendall."""
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, cols)


def high_pairs(matrix: DataFrame, threshold: float = 0.7, strict: bool = True) -> DataFrame:
    """Pairs above (strict) or from the threshold on, by |r|, the largest first."""
    test = F.abs("r") > threshold if strict else F.abs("r") >= threshold
    return matrix.filter(test).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative")).orderBy(F.desc(F.abs("r")), "a", "b")


def comissing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Correlation of being null; null for columns without nulls."""
    return _exploded(df, _pairs(cols or df.columns, lambda a, b: _correlation(F.col(a).isNull().cast("double"), F.col(b).isNull().cast("double"))))


def crosstab(df: DataFrame, x: str, y: str, zeros: bool = True) -> DataFrame:
    """x, y, n for every combination of values that occur; zeros adds those that never occur together (up to MOST_CELLS)."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    n = df.groupBy(key(x).alias("x"), key(y).alias("y")).agg(F.count("*").alias("n"))
    if not zeros:
        return n
    n = settle(n)
    size = n.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).first()
    if size["x"] * size["y"] > MOST_CELLS:
        raise HardStop(f"{size['x']} by {size['y']} cells; zeros=False gives those that occur")
    empty = n.select("x").distinct().crossJoin(F.broadcast(n.select("y").distinct())).withColumn("n", F.lit(0).cast("long"))
    return n.unionByName(empty).groupBy("x", "y").agg(F.sum("n").alias("n"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    return cramers_matrix(df, [x, y])


def cramers_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, v: bias-corrected Cramér's V of every two columns, with Yates' correction for a 2 x 2 table.

    Of counted cells that aren't empty and their margins, for all pairs at once: an empty cell adds what it was expected to hold.
    """
    pairs = list(combinations(cols, 2))
    cell = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(f"c{i}") for i, c in enumerate(cols)]
    at = [(f"c{i}", f"c{j}") for i, j in combinations(range(len(cols)), 2)]
    cells = settle(_pair_counts(df.select(*cell), at, "string"))
    c = F.col
    one = cells.groupBy("p").agg(F.sum("n").cast("double").alias("all"))
    t = cells
    for s, k in (("x", "r"), ("y", "k")):
        side = cells.groupBy("p", s).agg(F.sum("n").cast("double").alias(f"n{s}"))
        t = t.join(side, ["p", s])
        one = one.join(side.groupBy("p").agg(F.count("*").cast("double").alias(k), F.sum(1 / c(f"n{s}")).alias(f"inv_{s}")), "p")
    e = c("nx") * c("ny") / c("all")
    met = t.join(F.broadcast(one), "p").groupBy("p").agg(F.sum((c("n") - e) * (c("n") - e) / e - e).alias("s"))
    one = one.join(met, "p").withColumn("chi2", F.greatest(F.lit(0.0), c("s") + c("all")))
    # The four cells of a 2 x 2 table are equally far off.
    weight = c("all") * c("inv_x") * c("inv_y")
    off = F.sqrt(c("chi2") / weight)
    chi2 = F.when((c("r") == 2) & (c("k") == 2), F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) * weight).otherwise(c("chi2"))
    n, r, k = c("all"), c("r"), c("k")
    phi = F.greatest(F.lit(0.0), chi2 / n - F.try_divide((k - 1) * (r - 1), n - 1))
    least = F.least(k - F.try_divide((k - 1) * (k - 1), n - 1) - 1, r - F.try_divide((r - 1) * (r - 1), n - 1) - 1)
    return _named(one.select("p", F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0).alias("v")), pairs, "v")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """bin from 0, its lower edge and n; the last bin is closed."""
    c = F.col(col).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    at = df.filter(c.isNotNull()).select(c.alias("v")).join(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(bins - 1)), F.lit(0)).cast("long")
    return at.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first(step).alias("s")).select("bin", (F.col("lo") + F.col("bin") * F.col("s")).alias("lower_edge"), "n")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ends = own.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = own.join(F.broadcast(ends))
    b = lambda v: F.coalesce(F.least(F.floor(F.try_divide((F.col(v) - F.col(f"{v}0")) * bins, F.col(f"{v}1") - F.col(f"{v}0"))), F.lit(bins - 1)), F.lit(0)).cast("long")
    return at.groupBy(b("x").alias("x_bin"), b("y").alias("y_bin")).agg(F.count("*").alias("n"))


#: A kernel ends so many widths from its value: what is left out of a density is under exp(-32) / (width sqrt(2 pi)).
FAR = 8


def kde(df: DataFrame, col: str, points: int = 100, bins: int | None = None) -> DataFrame:
    """x, density on an even grid: Gaussian kernel, Scott's width n^(-1/5) times the sample deviation; null without spread.

    Equal values are counted first, and a value meets only the grid's points within FAR widths; with bins, values in one
    bin count as its middle, which bounds the work.
    """
    c = F.col(col).cast("double")
    if bins:
        h = histogram(df, col, bins).crossJoin(df.agg(((F.max(c) - F.min(c)) / bins).alias("w")))
        values = h.select((F.col("lower_edge") + F.col("w") / 2).alias("v"), F.col("n").cast("double").alias("n"))
    else:
        values = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").cast("double").alias("n"))
    par = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), (F.stddev_samp(c) * F.pow(F.count(c).cast("double"), F.lit(-0.2))).alias("h"), F.count(c).cast("double").alias("total"))
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)
    place = lambda v: F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")) * (points - 1)
    far = FAR * F.col("h")
    low, high = F.greatest(F.lit(0), F.ceil(place(F.col("v") - far))), F.least(F.lit(points - 1), F.floor(place(F.col("v") + far)))
    met = values.join(F.broadcast(par)).withColumns({"a": low, "b": high}).filter("a <= b").select("v", "n", "h", "lo", "hi", F.explode(F.sequence("a", "b")).alias("i"))
    k = F.exp(-F.pow((at(F.col("i")) - F.col("v")) / F.col("h"), F.lit(2.0)) / 2) * F.col("n")
    sums = met.groupBy("i").agg(F.sum(k).alias("s"))
    grid = par.filter("hi is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1)).cast("array<bigint>")).alias("i"))
    density = F.when(F.col("h").isNotNull() & (F.col("h") > 0), F.coalesce("s", F.lit(0.0)) / F.col("h") / F.col("total") / math.sqrt(2 * math.pi))
    return grid.join(sums, "i", "left").select(at(F.col("i")).alias("x"), density.alias("density"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


# Coefficients of a rational approximation of the inverse normal distribution (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(cs: tuple, x: Column, last: float | None = None) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out * x + last if last is not None else out


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function."""
    low = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _poly(_C, low) / _poly(_D, low, 1.0)
    q = p - 0.5
    r = q * q
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(_poly(_A, r) * q / _poly(_B, r, 1.0))


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """theoretical, sample: normal quantiles at Filliben's positions against the sorted values."""
    v = counted(df.select(F.col(col).cast("double").alias("v")), "v")
    at = each_place(v, "i").join(F.broadcast(v.agg(F.sum("__n").cast("double").alias("n"))))
    i, n = F.col("i"), F.col("n")
    top = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == 1, 1 - top).when(i == n, top).otherwise((i - 0.3175) / (n + 0.365))
    return at.select(normal_quantile(p).alias("theoretical"), F.col("__v").alias("sample"))


def qq_line(df: DataFrame, col: str) -> DataFrame:
    return qq_points(df, col).agg(F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept"), F.corr("sample", "theoretical").alias("r"))


# Cody's rational approximations of the error function, to 1.2e-16 near 0, up to 4 and beyond.
_ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_TAIL = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def erfc(x: Column) -> Column:
    """1 less the error function."""
    y = F.abs(x)
    s = 1 / F.greatest(y * y, F.lit(1e-300))
    share = lambda cs, v: _poly(cs[0], v) / _poly((1.0, *cs[1]), v)
    near = 1 - y * share(_ERF, y * y)
    tail = F.exp(-y * y) / y * (1 / math.sqrt(math.pi) - s * share(_TAIL, s))
    upper = F.when(y <= 0.46875, near).when(y <= 4, F.exp(-y * y) * share(_ERFC, y)).otherwise(tail)
    return F.when(x < 0, 2 - upper).otherwise(upper)


def anderson_darling(df: DataFrame, col: str) -> DataFrame:
    """statistic, critical_5pct, normal: the Anderson-Darling test against a normal law with estimated mean and deviation.

    Each distinct value counts once, with the sum of the weights of its places.
    """
    own = df.select(F.col(col).cast("double").alias("v"))
    par = own.agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))

    at = counted(own, "v").join(F.broadcast(par)).withColumn("z", (F.col("__v") - F.col("m")) / F.col("s") / math.sqrt(2))
    log = lambda z: F.ln(F.greatest(erfc(z) / 2, F.lit(1e-300)))
    at = at.withColumn("l", F.struct(log(-F.col("z")).alias("lo"), log(F.col("z")).alias("hi")))
    n, k, last = F.col("n"), F.col("__n").cast("double"), F.col("__upto").cast("double")
    up = k * (2 * last - k)  # of 2 i - 1 over the value's places
    one = at.agg((-F.first(n) - F.sum(up * F.col("l.lo") + (2 * n * k - up) * F.col("l.hi")) / F.first(n)).alias("statistic"), F.first(n).alias("n"))
    critical = F.round(0.787 / (1 + 4 / F.col("n") - 25 / F.col("n") / F.col("n")), 3)
    return one.select("statistic", critical.alias("critical_5pct"), (F.col("statistic") < critical).alias("normal"))


def shapiro_wilk(df: DataFrame, col: str, key: str, most: int = 5000) -> tuple[float, float]:
    """W and p by Royston's approximation, on a fixed sample of at most 5000 values (the test's own limit)."""
    from statistics import NormalDist

    from .rows import sample_rows

    x = np.sort([r[0] for r in sample_rows(df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"), key), most, key).collect()])
    n = len(x)
    if n < 3:
        raise ValueError("three values are needed")
    law = NormalDist()
    m = np.array([law.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    a = c.copy()
    if n > 5:
        a[-1] = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        a[-2] = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[0], a[1] = -a[-1], -a[-2]
    w = float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean())))
    y = math.log(max(1 - w, 1e-300))
    if n < 12:
        g = -2.273 + 0.459 * n
        mu, sd = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        y = -math.log(max(g - y, 1e-300))
    else:
        k = math.log(n)
        mu, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, 1 - law.cdf((y - mu) / sd)


def summary(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """count, mean, median, std, min, max of col, in all or by group."""
    c = F.col(col)
    own = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    names = ["n", "mean", "median", "std", "min", "max"]
    if not by:
        middle = quantiles(df, [col], [0.5]).agg(F.first("q")[0].alias("median"))
        return df.agg(*own).join(F.broadcast(middle)).select(*names)
    kept = df.filter(F.col(by).isNotNull())
    middle = quantiles(kept, [col], [0.5], [by]).select(by, F.col("q")[0].alias("median"))
    return kept.groupBy(by).agg(*own).join(middle, by, "left").select(by, *names)


def quartiles_by(df: DataFrame, col: str, by: str) -> DataFrame:
    kept = df.filter(F.col(by).isNotNull())
    q = quantiles(kept, [col], list(QUARTILES.values()), [by]).select(by, *[F.col("q")[i].alias(k) for i, k in enumerate(QUARTILES)])
    return kept.groupBy(by).agg(F.min(col).alias("min"), F.max(col).alias("max")).join(q, by, "left").select(by, "min", *QUARTILES, "max")


def radar(df: DataFrame, by: str, metrics: list[str], top: int = 5) -> DataFrame:
    """Means of metrics for the most frequent values of by."""
    stats = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return stats.orderBy(F.desc("n"), by).limit(top)
