"""Scores, flags and recommendations. Each reads the table by a few aggregates; rules work on their one-row results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import columns_of, settle
from . import statistics as st
from .columns import constant_columns, per_column, varies


@dataclass
class Facts:
    """What the scores need of a table."""

    rows: int
    columns: int
    missing: int
    duplicates: int
    constant: list[str]
    numeric: dict[str, dict]
    categorical: dict[str, dict]

    @property
    def cells(self) -> int:
        return max(self.rows * self.columns, 1)


def numeric_health(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """column_name, n, mean, median, std, skewness, kurtosis, cv_pct, fences, outliers (IQR and |z| > 3), and risks.

    stats: a profile_numeric() of df that is there already. Outliers are counted in one more pass against the profile's fences.
    """
    cols = cols or columns_of(df, "numeric")
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    stats = settle(st.profile_numeric(d, cols) if stats is None else stats)
    q1, q3 = F.col("q1"), F.col("q3")
    rows = {r["column_name"]: r for r in stats.select("column_name", (q1 - 1.5 * (q3 - q1)).alias("lo"), (q3 + 1.5 * (q3 - q1)).alias("hi"), "mean", "std").collect()}  # a row a column

    def counts(i: int, c: str):
        x, r = F.col(f"`{c}`"), rows[c]
        out = F.count(F.when((x < r["lo"]) | (x > r["hi"]), 1)) if r["lo"] is not None else F.lit(0)
        far = F.count(F.when(F.abs(x - r["mean"]) / r["std"] > 3, 1)) if r["std"] else F.lit(0)
        return F.struct(F.lit(c).alias("column_name"), out.cast("long").alias("outliers_iqr"), far.cast("long").alias("outliers_z"), F.lit(r["lo"]).cast("double").alias("lower_fence"), F.lit(r["hi"]).cast("double").alias("upper_fence")).alias(f"s{i}")

    out = d.agg(*[counts(i, c) for i, c in enumerate(cols)])
    counted = out.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s")).select("s.*")
    both = stats.join(F.broadcast(counted), "column_name").filter("n >= 4")
    pct = F.col("outliers_iqr") * 100.0 / F.col("n")
    risk = lambda test: F.when(test, "high").otherwise("low")
    return both.select("column_name", "n", "mean", "median", "std", "skewness", "kurtosis", F.coalesce(F.abs(F.try_divide("std", "mean")) * 100, F.lit(0.0)).alias("cv_pct"), "missing_pct", "zeros_pct", "lower_fence", "upper_fence", "outliers_iqr", pct.alias("outliers_pct"), "outliers_z", risk(F.abs("skewness") >= 2).alias("skew_risk"), risk(pct >= 5).alias("outlier_risk"))


def facts(df: DataFrame) -> Facts:
    """Counts of equal rows and of texts by a shuffle each; nulls, spread and moments in one pass, quartiles in one ordering, outliers in one pass."""
    dup = st.duplicate_counts(df).first()
    cells = per_column(df, lambda c: F.struct(F.count(c).alias("n"), varies(c).alias("varies")))
    missing = {c: dup["n_rows"] - v["n"] for c, v in cells.items()}
    numeric = {r["column_name"]: r.asDict() for r in numeric_health(df).collect()} if columns_of(df, "numeric") else {}
    categorical = {r["column_name"]: r.asDict() for r in st.profile_categorical(df).collect()} if columns_of(df, "categorical") else {}
    for c, n in missing.items():
        for kind in (numeric, categorical):
            if c in kind:
                kind[c] |= {"missing": n, "missing_pct": n * 100.0 / max(dup["n_rows"], 1)}
    return Facts(dup["n_rows"], len(df.columns), sum(missing.values()), dup["n_duplicates"], [c for c, v in cells.items() if not v["varies"]], numeric, categorical)


def cleaning_score(f: Facts) -> int:
    """Mean of what is left of 100 after 2 a % missing, 5 a % duplicates, 2 a % constant columns."""
    n = max(f.rows, 1)
    parts = (100 - 2 * f.missing * 100 / f.cells, 100 - 5 * f.duplicates * 100 / n, 100 - 2 * len(f.constant) * 100 / max(f.columns, 1))
    return int(sum(max(0.0, p) for p in parts) / 3)


def dimension_score(f: Facts, infinite: int = 0, consistency: float = 90, accuracy: float = 85, timeliness: float = 95) -> tuple[float, dict[str, float]]:
    """Six weighted dimensions; three of them are given, not measured. infinite: columns that hold an infinity."""
    d = {
        "completeness": 100 - f.missing / f.cells * 100, "validity": (f.columns - infinite) / max(f.columns, 1) * 100, "uniqueness": 100 - f.duplicates / max(f.rows, 1) * 100,
        "consistency": consistency, "accuracy": accuracy, "timeliness": timeliness,
    }
    w = {"completeness": 0.20, "validity": 0.20, "accuracy": 0.25, "consistency": 0.15, "timeliness": 0.10, "uniqueness": 0.10}
    return round(sum(d[k] * w[k] for k in d), 2), {k: round(v, 2) for k, v in d.items()}


def grade(score: float, bounds: tuple = (85, 70, 55, 40)) -> str:
    return next((g for g, b in zip("ABCD", bounds, strict=True) if score >= b), "F")


def readiness(f: Facts) -> tuple[float, str, dict[str, float]]:
    """0 to 100 from completeness (40), uniqueness (20), skew (20), cardinality (10) and constant columns (10), and a grade."""
    skews = [abs(c["skewness"]) for c in f.numeric.values() if c["skewness"] is not None]
    cards = [c["n_unique"] / max(f.rows, 1) for c in f.categorical.values()]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    parts = {
        "completeness": max(0.0, 1 - 2 * f.missing / f.cells) * 40, "uniqueness": max(0.0, 1 - 5 * f.duplicates / max(f.rows, 1)) * 20, "numeric": max(0.0, 1 - min(1.0, mean(skews) / 4)) * 20,
        "categorical": max(0.0, 1 - mean(cards)) * 10, "structure": max(0.0, 1 - len(f.constant) / max(f.columns, 1)) * 10,
    }
    total = round(min(100.0, sum(parts.values())), 1)
    return total, grade(total), {k: round(v, 1) for k, v in parts.items()}


def profile_score(f: Facts) -> float:
    """Mean of completeness, uniqueness and columns that vary, in %."""
    return (100 - f.missing / f.cells * 100 + 100 - f.duplicates / max(f.rows, 1) * 100 + (f.columns - len(f.constant)) / max(f.columns, 1) * 100) / 3


def structural_flags(df: DataFrame) -> dict:
    """Constant and nearly constant columns (deviation under 1 % of the mean), and whether there are 30 rows a column."""
    constant, rows = constant_columns(df), df.count()
    num = [c for c in columns_of(df, "numeric") if c not in constant]
    cv = df.agg(*[(F.stddev_samp(c) / (F.abs(F.avg(c)) + 1e-9)).alias(c) for c in num]).first().asDict() if num else {}
    return {"constant": constant, "near_constant": [c for c, v in cv.items() if v is not None and v < 0.01], "rows_per_column": rows / max(len(df.columns), 1), "enough_rows": rows >= 30 * len(df.columns)}


PRIORITIES = ("critical", "high", "medium", "low")


def recommendations(f: Facts) -> list[dict]:
    """What to look into, the most pressing first: priority, issue, column, value."""
    out = []

    def add(priority, issue, column, value):
        out.append({"priority": priority, "issue": issue, "column": column, "value": round(value, 4)})

    for c, s in (f.numeric | f.categorical).items():
        m = s["missing_pct"]
        if m > 5:
            add("critical" if m > 50 else "high" if m > 20 else "medium", "missing values", c, m)
    if f.duplicates:
        pct = f.duplicates * 100 / f.rows
        add("high" if pct > 10 else "medium" if pct > 5 else "low", "duplicate rows", None, pct)
    for c, s in f.numeric.items():
        if s["outliers_iqr"] and s["outliers_pct"] > 1:
            add("high" if s["outliers_pct"] > 15 else "medium" if s["outliers_pct"] > 5 else "low", "outliers", c, s["outliers_pct"])
    for c, s in f.numeric.items():
        if abs(s["skewness"] or 0) > 1:
            add("low", "highly skewed" if abs(s["skewness"]) > 2 else "moderately skewed", c, abs(s["skewness"]))
    if f.constant:
        add("medium", "constant columns", ", ".join(f.constant), len(f.constant))
    for c, s in f.categorical.items():
        if s["n_unique"] > 0.9 * f.rows:
            add("low", "high cardinality", c, s["n_unique"] * 100 / max(f.rows, 1))
    for c, s in f.numeric.items():
        if s["zeros_pct"] > 50:
            add("low", "mostly zeros", c, s["zeros_pct"])
    return sorted(out, key=lambda r: PRIORITIES.index(r["priority"]))


def assistant_score(recs: list[dict]) -> tuple[int, str]:
    """100 less 25, 15, 10 and 5 for each recommendation by priority, and a grade."""
    cost = dict(zip(PRIORITIES, (25, 15, 10, 5), strict=True))
    score = max(0, 100 - sum(cost[r["priority"]] for r in recs))
    return score, grade(score, (90, 80, 70, 60))


def summary_flags(f: Facts, pairs: int = 0) -> list[str]:
    """The few flags of a final assessment. pairs: column pairs with |r| from 0.85."""
    pct, dup = f.missing / f.cells * 100, f.duplicates * 100 / max(f.rows, 1)
    critical = [c for c, s in (f.numeric | f.categorical).items() if s["missing_pct"] >= 20]
    tests = (
        ("critical missingness", pct >= 20), ("critically missing columns", bool(critical)), ("significant duplicates", dup > 2),
        ("skewed distributions", any(s["skew_risk"] == "high" for s in f.numeric.values())), ("multicollinearity", pairs > 0),
    )
    return [name for name, on in tests if on]


def insights(f: Facts) -> list[str]:
    pct = f.missing / f.cells * 100
    out = [f"high share of missing values: {pct:.1f} %" if pct > 10 else f"missing values: {pct:.1f} %" if pct > 0 else "no missing values"]
    if f.duplicates:
        out.append(f"{f.duplicates} duplicate rows")
    if f.constant:
        out.append(f"{len(f.constant)} constant columns")
    if ids := [c for c, s in f.categorical.items() if s["n_unique"] > 0.9 * f.rows]:
        out.append(f"{len(ids)} columns of high cardinality")
    if skewed := [c for c, s in f.numeric.items() if abs(s["skewness"] or 0) > 2]:
        out.append(f"{len(skewed)} highly skewed columns")
    return out


def feature_hints(df: DataFrame) -> list[str]:
    """What columns suggest: date parts, bins, text lengths (mean over 20), interactions."""
    out, num = [], columns_of(df, "numeric")
    if dates := columns_of(df, "datetime"):
        out.append(f"date parts of {', '.join(dates[:2])}")
    if num:
        out.append("bins of continuous columns")
    texts = columns_of(df, "categorical")
    lengths = df.agg(*[F.avg(F.length(F.col(c).cast("string"))).alias(c) for c in texts]).first().asDict() if texts else {}
    if long := [c for c, v in lengths.items() if (v or 0) > 20]:
        out.append(f"text lengths of {', '.join(long[:2])}")
    if len(num) >= 2:
        out.append("products and ratios of numeric columns")
    return out


def column_metadata(df: DataFrame) -> DataFrame:
    """column_name, kind (binary, numeric, categorical), missing_pct, n_unique, relevance.

    Relevance is Target if a word of the name is target, label, class, status, outcome, result or y.
    """
    num = set(columns_of(df, "numeric"))
    targets = ["target", "label", "class", "status", "outcome", "result", "y"]
    # Values are counted first, by column: a hot value is a row a task, and no row is expanded. -0.0 is 0.0.
    cell = lambda c, t: (F.col(f"`{c}`") + F.lit(0.0).cast(t) if t in ("double", "float") else F.col(f"`{c}`")).cast("string")
    long = df.select(F.posexplode(F.array(*[cell(c, t) for c, t in df.dtypes])).alias("i", "v"))
    found = long.groupBy("i", "v").agg(F.count("*").alias("n")).groupBy("i").agg(
        F.count("v").alias("n_unique"), (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("m"),
        F.coalesce(F.min(F.col("v").isin("0", "1", "0.0", "1.0")), F.lit(False)).alias("bits"))
    names = df.sparkSession.createDataFrame([(i, c, c in num) for i, c in enumerate(df.columns)], "i int, column_name string, num boolean")
    rows = names.join(found, "i", "left").fillna({"n_unique": 0, "bits": False}).drop("i")
    kind = F.when(F.col("num"), F.when((F.col("n_unique") == 2) & F.col("bits"), "binary").otherwise("numeric")).when(F.col("n_unique") == 2, "binary").otherwise("categorical")
    rows = rows.withColumn("kind", kind).withColumn("missing_pct", F.col("m") * 100)
    target = F.arrays_overlap(F.split(F.lower("column_name"), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in targets]))
    high = ((F.col("kind") != "categorical") & (F.col("missing_pct") <= 30)) | ((F.col("kind") == "categorical") & F.col("n_unique").between(2, 20))
    relevance = F.when(target, "Target").when(F.col("missing_pct") > 50, "Low").when(high, "High").otherwise("Medium")
    return rows.select("column_name", "kind", "missing_pct", "n_unique", relevance.alias("relevance"))
