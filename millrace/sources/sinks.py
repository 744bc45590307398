"""Writing tables, SQL scripts, reports and projects."""

from __future__ import annotations

import html
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.ordered import ROW, with_row_id
from ..session import remove
from .delimited import QUOTING

# SQL types of the columns of a script.
SQL_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "TIMESTAMP"}
# Sizes of files as a share of the size in memory.
SIZE_FACTORS = {"csv": 0.8, "xlsx": 0.9, "json": 1.2, "parquet": 0.3, "sql": 1.0}


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8", header: bool = True, mode: str = "errorifexists") -> None:
    """Cells with separators, quotes or line breaks are in quotes, and quotes in them doubled; blanks at their ends stay."""
    df.write.mode(mode).options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **QUOTING).csv(path, sep=sep, encoding=encoding, header=header)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists") -> None:
    """snappy, gzip, zstd or none."""
    df.write.mode(mode).parquet(path, compression=compression)


def json_lines(df: DataFrame, orient: str = "records", dates: str = "iso", row: str | None = None) -> DataFrame:
    """value: records (an object a row), values (an array a row), index (an object by row), or columns (cells as column, row, cell)."""
    stamps = [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]
    if dates == "epoch":
        df = df.withColumns({c: F.unix_millis(F.col(c).cast("timestamp")) for c in stamps})
    cols = [c for c in df.columns if c != row]
    if orient == "records":
        return df.select(F.to_json(F.struct(*cols)).alias("value"))
    if orient == "values":
        return df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in cols])).alias("value"))
    if orient == "index":
        return df.select(F.to_json(F.create_map(F.col(row).cast("string"), F.struct(*cols))).alias("value"))
    return df.select(F.explode(F.array(*[F.to_json(F.struct(F.lit(c).alias("column"), F.col(row).alias("row"), F.col(c).cast("string").alias("cell"))) for c in cols])).alias("value"))


def json_document(df: DataFrame, orient: str = "columns", row: str = "row", dates: str = "iso", indent: bool = False) -> DataFrame:
    """ord, value: the lines, in order, of one JSON document: an object by row or by column, or an array of records or values.

    index is {row: {column: cell}}, columns {column: {row: cell}}; row names the column that identifies rows. Nulls are
    written. Lines are made where the rows are; nothing is collected.
    """
    stamps = [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]
    df = df.withColumns({c: F.unix_millis(F.col(c).cast("timestamp")) if dates == "epoch" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS") for c in stamps})
    cols = [c for c in df.columns if c != row]
    at = with_row_id(df, row, unique=True)
    space, gap = ("  ", " ") if indent else ("", "")
    plain = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    name = lambda c: F.to_json(F.struct(c.cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.cast("string").alias("v")))) - 6)
    comma = lambda pos: F.when(pos == 0, "").otherwise(",")
    if orient in ("records", "index", "values"):
        whole = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if orient != "values" else F.concat(F.lit("["), F.concat_ws(",", *[plain(c) for c in cols]), F.lit("]"))
        key = F.concat(name(F.col(row)), F.lit(f":{gap}")) if orient == "index" else F.lit("")
        body = at.select((F.col(ROW) + 1).alias("ord"), F.concat(F.lit(space), comma(F.col(ROW)), key, whole).alias("value"))
        ends = ("{", "}") if orient == "index" else ("[", "]")
        last = at.agg((F.count("*") + 1).alias("ord")).select("ord", F.lit(ends[1]).alias("value"))
        return df.sparkSession.createDataFrame([(0, ends[0])], "ord long, value string").unionByName(body).unionByName(last)
    n = at.count()
    step = n + 1
    head = [(i * step, ("{" if i == 0 else "},") + json.dumps(c) + f":{gap}{{") for i, c in enumerate(cols)] + [(len(cols) * step, "}}" if cols else "{}")]
    body = at.select(F.col(ROW), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), plain(c).alias("v")) for i, c in enumerate(cols)])).alias("x"), name(F.col(row)).alias("k"))
    body = body.select((F.col("x.i") * step + F.col(ROW) + 1).alias("ord"), F.concat(F.lit(space), comma(F.col(ROW)), "k", F.lit(f":{gap}"), "x.v").alias("value"))
    return df.sparkSession.createDataFrame(head, "ord long, value string").unionByName(body)


def write_json(df: DataFrame, path: str, orient: str = "records", mode: str = "errorifexists", document: bool = False, **kw) -> None:
    """A line for each row (or cell); with document one JSON document, which the part files are one after the other."""
    if document:
        json_document(df, orient, **kw).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.mode(mode).text(path)
    else:
        json_lines(df, orient, **kw).write.mode(mode).text(path)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """value: an INSERT for each row; quotes are doubled, nulls are NULL."""
    def lit(c, t):
        text = F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(F.col(c).cast("string") if t in ("bigint", "int", "smallint", "double", "float", "boolean") else text, F.lit("NULL"))

    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *[lit(c, t) for c, t in df.dtypes]), F.lit(");")).alias("value"))


def create_statement(df: DataFrame, table: str) -> str:
    return f"DROP TABLE IF EXISTS {table};\nCREATE TABLE {table} (\n" + ",\n".join(f"  {c} {SQL_TYPES.get(t, 'TEXT')}" for c, t in df.dtypes) + "\n);"


def sql_script(df: DataFrame, table: str, rows: int | None = 1000) -> str:
    """A script for a small table (rows at most); write_sql is for whole ones."""
    own = df.limit(rows) if rows is not None else df
    return "\n".join([create_statement(df, table), *[r[0] for r in insert_statements(own, table).collect()]])


def write_sql(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    """Every row, in part files; the statement that makes the table is create_statement()."""
    insert_statements(df, table).write.mode(mode).text(path)


def size_estimate(df: DataFrame, fmt: str) -> float:
    """Bytes, by the optimiser's estimate of the plan."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * SIZE_FACTORS[fmt]


def measured_sizes(df: DataFrame) -> DataFrame:
    """format, bytes: what files are likely to take, by the cells: texts as long as they are, other cells 8 bytes, booleans 1."""
    cell = lambda c, t: F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) if t not in SQL_TYPES else F.lit(1 if t == "boolean" else 8)
    whole = df.agg(F.coalesce(F.sum(sum((cell(c, t).cast("long") for c, t in df.dtypes), F.lit(0).cast("long"))), F.lit(0)).alias("b"))
    formats = F.array(*[F.struct(F.lit(f).alias("format"), F.lit(x).alias("x")) for f, x in SIZE_FACTORS.items()])
    return whole.select("b", F.inline(formats)).select("format", (F.col("b") * F.col("x")).alias("bytes"))


def html_report(df: DataFrame, title: str = "Report") -> str:
    f = q.facts(df)
    score, dims = q.dimension_score(f)
    rows = sorted(((c, s["missing"], s["missing_pct"]) for c, s in (f.numeric | f.categorical).items() if s["missing"]), key=lambda r: -r[1])
    cell = lambda *x: "<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in x) + "</tr>"
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>
<p>{f.rows} rows, {f.columns} columns, {f.duplicates} duplicates. Score {score}.</p>
<table>{"".join(cell(k, v) for k, v in dims.items())}</table>
<table>{cell("numeric", len(f.numeric))}{cell("categorical", len(f.categorical))}</table>
<table>{"".join(cell(c, n, f"{p:.2f} %") for c, n, p in rows)}</table></body></html>"""


def project_name(name: str) -> str:
    """Letters, digits, spaces, - and _ only."""
    return re.sub(r"[^A-Za-z0-9 _-]", "", name).strip() or "project"


def save_project(df: DataFrame, root: str, name: str, meta: dict | None = None) -> str:
    """Parquet and one line of JSON; nothing is pickled."""
    at = str(PurePosixPath(root) / project_name(name)) if "://" not in root else f"{root}/{project_name(name)}"
    df.write.mode("overwrite").parquet(f"{at}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps({"name": name, "columns": df.columns} | (meta or {}), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
    return at


def load_project(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict]:
    at = f"{root}/{project_name(name)}"
    return spark.read.parquet(f"{at}/data"), json.loads(spark.read.text(f"{at}/meta").first()[0])


def list_projects(spark: SparkSession, root: str) -> list[str]:
    jvm, sc = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def delete_project(spark: SparkSession, root: str, name: str) -> bool:
    return remove(spark, f"{root}/{project_name(name)}")
