"""Selection, renaming and restructuring of columns."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.result import HardStop
from ..session import columns_of


def need(df: DataFrame, *cols: str) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise HardStop(f"no such columns: {missing}")


def select(df: DataFrame, *cols: str, search: str | None = None) -> DataFrame:
    """The named columns, or those whose names contain a text."""
    need(df, *cols)
    return df.select(*cols) if cols else df.select(*[c for c in df.columns if search and search.lower() in c.lower()])


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of(df, kind))


def drop(df: DataFrame, *cols: str) -> DataFrame:
    need(df, *cols)
    return df.drop(*cols)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    need(df, *names)
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise HardStop("two columns would have the same name")
    return df.toDF(*new)


def standard_name(name: str, trim: bool = True, lower: bool = True, underscores: bool = True) -> str:
    name = name.strip() if trim else name
    name = name.lower() if lower else name
    return re.sub(r"[ -]", "_", name) if underscores else name


def name_issues(name: str) -> list[str]:
    tests = {"surrounding white space": name != name.strip(), "double spaces": "  " in name, "special characters": bool(re.search(r"[^\w\s]", name))}
    return [k for k, v in tests.items() if v]


def standardise_names(df: DataFrame, **rules: bool) -> DataFrame:
    return rename(df, {c: standard_name(c, **rules) for c in df.columns})


def clean_names(names: list) -> list[str]:
    """Names for a table of unsure origin: blank, unnamed and numeric ones are Column_i, breaks are _, repeats get _k."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        n = re.sub(r"[\n\r\t]", "_", "" if raw is None else str(raw)).strip()
        if not n or n.lower().startswith("unnamed") or re.fullmatch(r"\d+(\.\d+)?", n):
            n = f"Column_{i}"
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        seen.setdefault(n, 0)
        out.append(n)
    return out


def split_column(df: DataFrame, col: str, sep: str, names: list[str], keep: bool = True) -> DataFrame:
    """The parts of col by a literal separator; the last takes the rest, missing ones are null."""
    need(df, col)
    parts = F.split(F.col(col).cast("string"), re.escape(sep), len(names))
    df = df.withColumns({n: F.get(parts, i) for i, n in enumerate(names)})
    return df if keep or col in names else df.drop(col)


def merge_columns(df: DataFrame, cols: list[str], name: str, sep: str = " ", keep: bool = True) -> DataFrame:
    """The texts of cols joined by sep, null as empty; an existing name is a hard stop."""
    need(df, *cols)
    if name in df.columns:
        raise HardStop(f"column {name} exists")
    df = df.withColumn(name, F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df if keep else df.drop(*cols)


def per_column(df: DataFrame, what, cols: list[str] | None = None, chunk: int = 200) -> dict[str, object]:
    """what(column) of every column, in one pass for each chunk of columns."""
    cols, out = cols or df.columns, {}
    for i in range(0, len(cols), chunk):
        own = cols[i : i + chunk]
        out |= dict(zip(own, df.agg(*[what(F.col(f"`{c}`")).alias(f"c{j}") for j, c in enumerate(own)]).first(), strict=True))
    return out


def missing_share(df: DataFrame) -> dict[str, float]:
    return per_column(df, lambda c: F.coalesce(F.avg(c.isNull().cast("double")), F.lit(0.0)))


def varies(c: Column) -> Column:
    """Has a column two values or more? Least and greatest tell; no distinct count is needed."""
    return F.coalesce(F.min(c) < F.max(c), F.lit(False))


def constant_columns(df: DataFrame) -> list[str]:
    return [c for c, v in per_column(df, varies).items() if not v]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def drop_missing(df: DataFrame, percent: float = 50) -> DataFrame:
    """Without columns of which more than percent % is missing."""
    return df.drop(*[c for c, m in missing_share(df).items() if m * 100 > percent])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows and columns that are all null."""
    return df.drop(*[c for c, n in per_column(df, F.count).items() if not n]).na.drop(how="all")


def free_names(df: DataFrame, var: str = "variable", value: str = "value") -> tuple[str, str]:
    """Names for a melt that clash with no column."""
    def free(stem: str) -> str:
        return stem if stem not in df.columns else next(n for k in count(1) if (n := f"{stem}_{k}") not in df.columns)

    return free(var if var not in df.columns else f"{var}_var"), free(value if value not in df.columns else f"{value}_val")


def matching(names: list[str], pattern: str) -> list[str]:
    return [n for n in names if re.search(pattern, n)]
