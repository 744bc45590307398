"""Type conversion, with or without quarantine, and what types suit a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_any

# Words that stand for true and false.
TRUE_WORDS = ["true", "yes", "1", "t", "y", "1.0", "active", "approved", "pass", "on", "enabled", "success", "accept", "present"]
FALSE_WORDS = ["false", "no", "0", "f", "n", "0.0", "inactive", "rejected", "fail", "off", "disabled", "failure", "decline", "absent"]
# What a boolean may be turned into, (true, false).
BOOLEAN_FORMS = {"bool": (True, False), "yes/no": ("Yes", "No"), "1/0": (1, 0), "y/n": ("Y", "N"), "active/inactive": ("Active", "Inactive"), "enabled/disabled": ("Enabled", "Disabled")}


def number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def boolean(c: Column, form: str | tuple = "bool") -> Column:
    """form: a name, or the two values for true and false."""
    t, f = BOOLEAN_FORMS[form] if isinstance(form, str) else form
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), F.lit(t)).when(word.isin(FALSE_WORDS), F.lit(f))


def converted(c: Column, to: str) -> Column:
    if to == "int64":
        return F.when(number(c).between(-9.2e18, 9.2e18), number(c).cast("long"))
    return {"float64": number, "bool": boolean, "datetime64": lambda x: parse_any(x.cast("string")), "object": lambda x: x.cast("string"), "category": lambda x: x.cast("string")}[to](c)


def convert_or_quarantine(df: DataFrame, col: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(rows that convert, rows that don't). A null isn't a failure; as int64 it becomes 0."""
    both = df.withColumn("__v", converted(F.col(col), to))
    failed = F.col("__v").isNull() & F.col(col).isNotNull()
    value = F.coalesce("__v", F.lit(0)) if to == "int64" else F.col("__v")
    return both.filter(~failed).withColumn(col, value).drop("__v"), both.filter(failed).drop("__v")


def convert(c: Column, to: str, null_as_zero: bool = False, form: str = "bool") -> Column:
    """Without quarantine: what doesn't convert is null. int rounds half to even."""
    out = {"int": F.bround(number(c)).cast("long"), "float": number(c), "string": c.cast("string"), "category": c.cast("string"), "datetime": parse_any(c.cast("string")), "boolean": boolean(c, form)}[to]
    return F.coalesce(out, F.lit(0)) if null_as_zero and to in ("int", "float") else out


def parse_rates(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float, float]]:
    """For text columns: shares of all rows that are numbers and dates, and of non-null values that are numbers."""
    what = []
    for c in cols:
        ok, date = number(F.col(c)).isNotNull().cast("double"), parse_any(F.col(c)).isNotNull().cast("double")
        what.append(F.array(F.coalesce(F.avg(ok), F.lit(0.0)), F.coalesce(F.avg(date), F.lit(0.0)), F.coalesce(F.avg(F.when(F.col(c).isNotNull(), ok)), F.lit(0.0))).alias(c))
    return {c: tuple(v) for c, v in df.agg(*what).first().asDict().items()} if cols else {}


def auto_convert(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Text columns of which more than share of all rows parse become numbers, else dates. Cells that don't parse are null;
    conversion_losses() counts them."""
    rates = parse_rates(df, [c for c, t in df.dtypes if t == "string"])
    return df.withColumns({c: number(F.col(c)) if n > share else parse_any(F.col(c)) for c, (n, d, _) in rates.items() if max(n, d) > share})


def conversion_losses(before: DataFrame, after: DataFrame) -> dict[str, int]:
    """For columns that have another type after auto_convert(): how many cells didn't parse."""
    kinds = dict(after.dtypes)
    cols = [c for c, t in before.dtypes if t == "string" and kinds.get(c, t) != t]
    if not cols:
        return {}
    had = before.agg(*[F.count(c).alias(c) for c in cols]).first()
    has = after.agg(*[F.count(c).alias(c) for c in cols]).first()
    return {c: had[c] - has[c] for c in cols}


def suggest_types(df: DataFrame) -> dict[str, str]:
    """datetime64 or float64 for text columns of which over 70 % of the values look so, category for few distinct values."""
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return {}
    is_date, is_num = r"^\d{4}-\d{1,2}-\d{1,2}|^\d{1,2}/\d{1,2}/\d{2,4}", r"^\s*-?[\d,]*\.?\d+\s*$"
    share = lambda c, p: F.avg(F.col(c).rlike(p).cast("double"))
    seen = df.agg(*[F.array(share(c, is_date), share(c, is_num), F.approx_count_distinct(c) / F.greatest(F.count("*"), F.lit(1))).alias(c) for c in cols]).first()
    out = {c: "datetime64" if (d or 0) > 0.7 else "float64" if (n or 0) > 0.7 else "category" if few < 0.05 else None for c in cols for d, n, few in [seen[c]]}
    return {c: t for c, t in out.items() if t}


def numeric_like(df: DataFrame, share: float = 0.5) -> list[str]:
    cols = [c for c, t in df.dtypes if t == "string"]
    return [c for c, (_, _, n) in parse_rates(df, cols).items() if n >= share]
