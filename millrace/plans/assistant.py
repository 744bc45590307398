"""A rule-based assistant: what a request asks for, which columns it names, in which order to work, and what to do first."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q
from ..session import column_classes

# Words of a request that stand for an intent.
INTENTS = {
    "analyze_data": ["analyze", "check data", "what should i do", "what to do", "help me", "guide me", "where to start", "data quality", "check quality", "inspect data", "review data"],
    "clean_data": ["clean", "clean data", "clean my data", "fix data", "prepare data", "fix issues", "improve quality"],
    "check_issues": ["issues", "problems", "what's wrong", "find issues", "detect issues", "data problems", "check for problems"],
    "remove_nulls": ["null", "missing", "nan", "empty", "blank", "remove missing", "fill missing", "handle missing", "missing values", "missing data"],
    "remove_duplicates": ["duplicate", "duplicates", "repeated", "duplicate rows", "remove duplicates", "drop duplicates", "unique rows"],
    "remove_outliers": ["outlier", "outliers", "extreme values", "anomaly", "anomalies", "remove outliers", "handle outliers", "outlier detection"],
    "remove_constant": ["constant column", "constant columns", "same value", "no variation", "remove constant", "drop constant"],
    "standardize_text": ["lowercase", "uppercase", "title case", "standardize", "clean text", "normalize text", "trim whitespace"],
    "filter_rows": ["filter", "where", "rows where", "select rows", "subset", "filter by", "keep rows", "remove rows"],
    "select_columns": ["select column", "keep column", "choose column", "pick column", "drop column", "remove column", "columns only"],
    "sort_data": ["sort", "order", "sort by", "order by", "arrange", "ascending", "descending"],
    "rename_column": ["rename", "rename column", "change name", "column name"],
    "create_column": ["create column", "new column", "add column", "calculated column", "compute column", "derive column"],
    "pivot": ["pivot", "pivot table", "wide format", "reshape wide"],
    "melt": ["melt", "unpivot", "long format", "reshape long"],
    "datetime_features": ["extract", "datetime", "date", "year", "month", "day", "hour", "minute", "day of week", "extract date", "parse date"],
    "math_features": ["multiply", "divide", "add", "subtract", "power", "ratio", "product", "sum", "difference", "polynomial"],
    "aggregation": ["group by", "aggregate", "mean by", "sum by", "count by", "average by", "groupby", "group"],
    "interaction": ["interaction", "combine", "cross", "multiply columns"],
    "transformation": ["log", "sqrt", "normalize", "standardize", "scale", "transform", "log transform", "square root"],
    "chart": ["chart", "plot", "graph", "visualize", "visualization", "show", "display"],
    "histogram": ["histogram", "distribution", "frequency"],
    "scatter": ["scatter", "scatter plot", "relationship", "correlation plot"],
    "bar_chart": ["bar chart", "bar plot", "bar graph", "bars"],
    "line_chart": ["line chart", "line plot", "time series", "trend"],
    "box_plot": ["box plot", "boxplot", "box and whisker"],
    "export": ["export", "download", "save", "save as", "export to"],
}
# The order in which work is done.
ORDER = {"analyze_data": 0, "check_issues": 0, "remove_nulls": 1, "remove_duplicates": 2, "remove_outliers": 3, "remove_constant": 4, "clean_data": 5, "filter_rows": 6, "select_columns": 7, "create_column": 8, "datetime_features": 9, "math_features": 10, "aggregation": 11, "transformation": 12, "chart": 13, "export": 14}
# Requests that ask what the data needs.
DATA_AWARE = ["what should", "what to do", "analyze", "check data", "find issues", "help me", "guide me", "clean data", "data quality", "what's wrong", "problems"]
# Usual sequences of work.
TEMPLATES = {
    "auto_clean": ["review quality", "missing values", "duplicates", "outliers"],
    "clean_and_visualize": ["missing values", "duplicates", "chart"],
    "prepare_for_analysis": ["missing values", "outliers", "filter and select", "features"],
    "time_series_analysis": ["convert to datetime", "date parts", "time series chart"],
    "feature_creation": ["mathematical features", "group features", "review features"],
}
# Words of a goal that stand for a sequence, the first that all occur; one of several after |.
GOALS = (("clean visualize", "clean_and_visualize"), ("prepare|analysis", "prepare_for_analysis"), ("time series|date", "time_series_analysis"), ("feature|engineer", "feature_creation"))
#: What to know about a step.
GUIDANCE = {
    "remove_nulls": "treat each column by its type and by how much of it is missing", "remove_outliers": "quartile fences suit most columns", "create_column": "an expression over columns",
    "datetime_features": "year, month, day, day of week and weekend are usual", "aggregation": "group by text columns, aggregate numeric ones", "transformation": "a log suits columns with a long right tail",
    "chart": "the kind of chart follows from the types of the columns", "pivot": "wide tables suit reports", "melt": "long tables suit charts", "analyze_data": "start with the profile", "clean_data": "missing values and duplicates come first",
}
#: (an intent that is there, one that isn't, what else to think of)
NEXT = (("remove_nulls", "remove_duplicates", "look for duplicates, too"), ("create_column", "chart", "draw the new column"), ("datetime_features", "chart", "draw a time series"), ("remove_outliers", "chart", "draw the distribution without outliers"))
VERIFY = {"remove_nulls", "remove_outliers", "transformation"}
#: What a step needs of its columns.
_KINDS = {"remove_outliers": "numeric", "transformation": "numeric", "math_features": "numeric", "datetime_features": "datetime", "bar_chart": "categorical", "aggregation": "categorical"}


@dataclass
class Request:
    intents: list[str]
    columns: list[str]
    confidence: float
    data_aware: bool


def parse(text: str, names: list[str] | tuple[str, ...] = ()) -> Request:
    """What a request asks for; columns are those of names that it has as words, and whatever it quotes."""
    low = (text or "").lower().strip()
    if not low:
        return Request([], [], 0.0, False)
    intents = [i for i, words in INTENTS.items() if any(w in low for w in words)]
    quoted = [x for pair in re.findall(r"'([^']+)'|\"([^\"]+)\"|`([^`]+)`", text) for x in pair if x]
    own = [c for c in names if re.search(rf"(?<!\w){re.escape(c.lower())}(?!\w)", low)]
    columns = list({c.lower(): c for c in [*own, *quoted]}.values())
    return Request(intents, columns, min(1.0, 0.3 * len(intents) + 0.2 * bool(columns)), any(w in low for w in DATA_AWARE))


def find_column(df: DataFrame, name: str) -> tuple[str | None, str | None]:
    """(column, class), or (None, a suggestion)."""
    kinds = column_classes(df)
    for c in df.columns:
        if c.lower() == name.lower():
            return c, kinds[c]
    return None, next((c for c in df.columns if name.lower() in c.lower()), None)


def template(goal: str) -> list[str]:
    """The usual sequence of work for a goal; none if it names nothing known."""
    low = goal.lower()
    for words, name in GOALS:
        if any(w in low for w in words.split("|")) if "|" in words else all(w in low for w in words.split()):
            return TEMPLATES[name]
    return []


def follow_ups(intents: list[str]) -> list[str]:
    out = [text for there, missing, text in NEXT if there in intents and missing not in intents]
    return out + ["look at the profile again"] * bool(VERIFY & set(intents))


@dataclass
class Answer:
    steps: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)
    summary: dict = field(default_factory=dict)


def answer(df: DataFrame, text: str) -> Answer:
    """Ordered steps for a request; for one that asks what to do, the ten most pressing recommendations."""
    asked, out = parse(text, df.columns), Answer()
    if asked.data_aware:
        recs = q.recommendations(q.facts(df))
        score, grade = q.assistant_score(recs)
        out.steps = [{"step": i, "operation": r["issue"], "columns": [r["column"]] if r["column"] else [], "priority": r["priority"]} for i, r in enumerate(recs[:10], 1)]
        out.summary = {"score": score, "grade": grade, "issues": len(recs)}
        n = {p: sum(r["priority"] == p for r in recs) for p in q.PRIORITIES}
        out.suggestions = [t for t, on in (("start with critical and high priorities", score < 70), ("critical issues come before any analysis", n["critical"] > 0), ("low priorities are optional", n["low"] > 5)) if on]
        return out
    if not asked.intents:
        out.warnings.append("nothing in the request is understood")
    known = {}
    for name in asked.columns:
        c, about = find_column(df, name)
        if c:
            known[c] = about
        else:
            out.warnings.append(f"no column {name}" + (f"; is it {about}?" if about else ""))
    for i, intent in enumerate(sorted(asked.intents, key=lambda x: ORDER.get(x, 999)), 1):
        need = _KINDS.get(intent)
        out.steps.append({"step": i, "operation": intent, "columns": [c for c, k in known.items() if need in (None, k)], "guidance": GUIDANCE.get(intent)})
    out.suggestions = follow_ups(asked.intents)
    return out


def intents_of(df: DataFrame, col: str, out: str = "intents") -> DataFrame:
    """df with the intents of the request in col, in the order in which steps are taken; none for a null or empty one.

    Equal requests are parsed once in a task.
    """
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        known = {t: sorted(parse(t).intents, key=lambda x: ORDER.get(x, 999)) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t, []))

    return df.withColumn(out, run(F.col(col)))
