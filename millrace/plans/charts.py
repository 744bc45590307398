"""The tables behind charts. Drawing is up to the caller; each of these is small or sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered as o
from ..operators import statistics as st
from ..operators.rows import sample_rows

ABOVE, TO = 50_000, 20_000


def downsample(df: DataFrame, key: str, above: int = ABOVE, to: int = TO) -> DataFrame:
    """to fixed rows of a table of more than above rows."""
    return sample_rows(df, to, key) if df.limit(above + 1).count() > above else df


def univariate(df: DataFrame, kind: str, col: str, bins: int = 30, top: int | None = 20) -> DataFrame:
    """histogram, box, violin, strip, density, qq, bar, pie, donut, treemap."""
    if kind in ("bar", "pie", "donut", "treemap"):
        return st.value_counts(df, col, top)
    return {"histogram": lambda: st.histogram(df, col, bins), "density": lambda: st.kde(df, col, 200), "qq": lambda: st.qq_points(df, col)}.get(kind, lambda: st.profile_numeric(df, [col]))()


def _first(points: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n points, in order; the order is over ranges, so n may be large."""
    return o.with_row_id(points, *[F.asc_nulls_last(c) for c in order]).filter(F.col(o.ROW) < n).orderBy(o.ROW).drop(o.ROW)


def bivariate(df: DataFrame, kind: str, x: str, y: str, key: str | None = None, bins: int = 20, first: int | None = None) -> DataFrame:
    """scatter, line, joint, hexbin, box, violin, strip, bar, grouped, stacked, heatmap, sunburst.

    Lines have all points, the others of points a sample if there are many; first: the first so many instead, by key, lines by x and key.
    """
    if kind in ("grouped", "stacked", "heatmap", "sunburst"):
        return st.crosstab(df, x, y)
    if kind == "hexbin":
        return st.histogram_2d(df, x, y, bins)
    if kind == "bar":
        return df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.avg(y).alias(f"mean_{y}"))
    if kind in ("box", "violin", "strip"):
        return st.quartiles_by(df, y, x)
    points = df.select(x, y, *[key] if key and key not in (x, y) else [])
    if first is not None:
        return _first(points, first, *dict.fromkeys([*([x] if kind == "line" else []), key or x]))
    return points.orderBy(x) if kind == "line" else downsample(points, key or x)


def multivariate(df: DataFrame, kind: str, cols: list[str], by: str | None = None, key: str | None = None, to: int = TO) -> DataFrame:
    """heatmap (of correlations), radar, and matrix, parallel, 3d, bubble (samples of to rows)."""
    if kind == "heatmap":
        return st.pearson(df, cols)
    if kind == "radar":
        return st.radar(df, by, cols)
    return downsample(df.select(*dict.fromkeys([*cols, *([by] if by else []), *([key] if key else [])])), key or cols[0], to=to)


def time_series(df: DataFrame, kind: str, ts: str, cols: list[str], window: int = 7) -> DataFrame:
    """line, area, multi, rolling (mean of window rows) and range (least, mean and greatest at each time)."""
    if kind == "range":
        return df.groupBy(ts).agg(F.min(cols[0]).alias("least"), F.avg(cols[0]).alias("mean"), F.max(cols[0]).alias("greatest")).orderBy(ts)
    if kind == "rolling":
        at = o.with_row_id(df.select(ts, *cols), ts, *cols)
        return o.rolling_mean(at, cols[0], window, "rolling").orderBy(o.ROW).drop(o.ROW)
    return df.select(ts, *cols).orderBy(ts)
