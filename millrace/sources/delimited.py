"""CSV whose cells may hold line breaks and quotes, read in blocks.

Files are split into blocks of lines, and a line break inside quotes ends no record. Whether a block begins inside a cell
follows from all blocks before it (tasks read lines as they come and keep none): each block says, for either case, in which one it ends and whether a record begins in
it, and these functions, one row a block, are composed along each file. Then every block is cut into records where it is,
and the parts of a record that crosses borders, two a block at most, are joined. Records are parsed by from_csv.

Where no line can end inside quotes, which one pass of counting tells, lines are records and Spark's own reader, with the
same parser, does all of it.
"""

from __future__ import annotations

import csv
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: What the parser is told, reading and writing: quotes are doubled inside quotes.
QUOTING = {"quote": '"', "escape": '"'}
#: Reading, an empty cell without quotes is null; what stands for it inside the parser is no text of a file.
READING = QUOTING | {"nullValue": "\ue000null\ue000"}
#: Bytes and rows of a batch that a task gives.
OUT_BYTES, OUT_ROWS = 4 << 20, 10_000


def may_break(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether a line may end inside quotes: it has an odd number of them, or one that neither begins nor ends a cell."""
    v, s = F.col("value"), re.escape(sep)
    quotes = F.octet_length(v) - F.octet_length(F.replace(v, F.lit('"'), F.lit("")))
    odd = (quotes > 0) & ((quotes % 2 == 1) | v.rlike(f'[^"{s}]"[^"{s}]'))
    return bool(spark.read.text(path).agg(F.max(odd).alias("odd")).first()["odd"])


class Lines:
    """What a line does to a reader that comes to it between records, or inside a quoted cell."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        cell = rb'(?:"(?:[^"]++|"")*+"[^S]*+|[^"S][^S]*+|)'.replace(b"S", s)
        rest = rb"(?:S" + cell + rb")*+"
        rest = rest.replace(b"S", s, 1)
        self.whole = re.compile(cell + rest, re.S)
        self.end = re.compile(rb'(?:[^"]++|"")*+"[^S]*+'.replace(b"S", s) + rest, re.S)

    def inside(self, line: bytes, inside: bool) -> bool:
        """Whether the line ends inside quotes."""
        if b'"' not in line:
            return inside
        return not (self.end if inside else self.whole).fullmatch(line)


def _blocks(batches, skip: int):
    """(what all lines of a block have: file, start and so on; its lines, one by one); the first lines of a file are left out."""
    flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for own, rows in itertools.groupby(flat, lambda row: row[:-1]):
        yield own, itertools.islice((row[-1] for row in rows), 0 if own[1] else skip, None)


#: What a piece of a block is: the end of a record of blocks before, a record, the beginning of one that goes on.
HEAD, RECORD, TAIL = range(3)


def _cut(lines, inside: bool, of: Lines):
    """(HEAD, RECORD or TAIL, bytes) of a block, as its lines come. Blank lines are no records."""
    part, before = [], inside
    for line in lines:
        now = of.inside(line, inside)
        if inside or now:
            part.append(line)
            if not now:
                yield (HEAD if before else RECORD), b"\n".join(part)
                part, before = [], False
        elif line.strip():
            yield RECORD, line
        inside = now
    if part:
        yield (HEAD if before else TAIL), b"\n".join(part)


def _batches(rows, schema: pa.Schema):
    """Rows whose last cell is bytes, in batches of about so many of them."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1])
        if size >= OUT_BYTES or len(some) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _functions(lines: DataFrame, sep: str, skip: int) -> DataFrame:
    """(file, start, ends, begins, header): for a block that begins between records, and inside a cell, whether it ends
    inside one, and whether that one's record begins in it; and a file's first record."""

    def run(batches):
        of = Lines(sep)
        for (file, start), own in _blocks(batches, skip):
            states, begun, part, first = [False, True], [False, False], [], None
            for line in own:
                now = [of.inside(line, inside) for inside in states] if b'"' in line else states
                if first is None and not start:  # the first record, as between records at the beginning
                    if now[0] or states[0]:
                        part.append(line)
                    if states[0] and not now[0]:
                        first = b"\n".join(part)
                    elif not states[0] and not now[0] and line.strip():
                        first = line
                begun = [(begun[k] or not states[k]) and now[k] for k in (0, 1)]
                states = now
            ends, begins = states, begun
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((file, pa.string()), (start, pa.int64()), (ends, pa.list_(pa.bool_())), (begins, pa.list_(pa.bool_())), (first, pa.binary()))], names=["file", "start", "ends", "begins", "header"])

    return lines.mapInArrow(run, "file string, start long, ends array<boolean>, begins array<boolean>, header binary")


def _entries(functions: DataFrame) -> DataFrame:
    """(file, start, inside, owner, left): whether a block begins inside a cell, in which block that cell's record begins,
    and whether the block ends inside one."""

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")  # one row a block
        inside, owner, out = False, None, []
        for start, ends, begins in zip(*(t.column(c).to_pylist() for c in ("start", "ends", "begins")), strict=True):
            out.append((inside, owner if inside else start, ends[inside]))
            owner = start if begins[inside] else owner
            inside = ends[inside]
        states, owners, left = zip(*out, strict=True)
        return pa.table({"file": t.column("file"), "start": t.column("start"), "inside": pa.array(states), "owner": pa.array(owners, pa.int64()), "left": pa.array(left)})

    return functions.select("file", "start", "ends", "begins").groupBy("file").applyInArrow(compose, "file string, start long, inside boolean, owner long, left boolean")


def _records(lines: DataFrame, entries: DataFrame, sep: str, skip: int, header: bool, across: bool) -> DataFrame:
    """(raw): the records of all blocks, without headers and blank lines. Only where one isn't over at a block's end (across) are parts joined."""

    def cut(parts: bool):
        def rows(batches):
            of = Lines(sep)
            for (file, start, inside, owner), own in _blocks(batches, skip):
                left_out = int(header and not start)
                for kind, value in _cut(own, inside, of):
                    if kind == RECORD and not parts:
                        if not left_out:
                            yield (value,)
                        left_out = 0
                    elif kind != RECORD and parts:
                        yield file, owner if kind == HEAD else start, start, value

        def run(batches):
            kinds = [("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("part", pa.binary())] if parts else [("raw", pa.binary())]
            yield from _batches(rows(batches), pa.schema(kinds))

        return run

    told = lines.join(F.broadcast(entries), ["file", "start"]).select("file", "start", "inside", "owner", "value")  # a row a block of the files
    whole = told.mapInArrow(cut(False), "raw binary")
    if not across:
        return whole
    parts = told.mapInArrow(cut(True), "file string, owner long, start long, part binary")
    joined = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("p"))
    return whole.unionByName(joined.select(F.reduce("p.part", F.lit(b""), lambda a, b: F.when(F.length(a) == 0, b).otherwise(F.concat(a, F.lit(b"\n"), b))).alias("raw")))


def read_csv(spark: SparkSession, path: str, header: bool = True, skip_rows: int = 0, sep: str = ",", encoding: str = "utf-8", schema=None) -> DataFrame:
    """The records of a file or folder. Cells may hold separators, line breaks and doubled quotes, in quotes.

    skip_rows lines at each file's beginning are left out, and its next record is the header, unless header is False. An
    empty cell is null, one of two quotes is empty; short records are filled with nulls. Without a schema columns are
    text. Encodings whose line breaks are not single bytes (utf-16, utf-32) are read by one task a file.
    """
    wide = encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32"))
    if wide or not (skip_rows or may_break(spark, path, sep)):
        reader = spark.read.options(sep=sep, encoding=encoding, **READING)
        out = (reader.schema(schema) if schema else reader).csv(path, header=header, multiLine=wide)
        return out.toDF(*_unmarked(out.columns)) if header and not schema else out
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.col("value").cast("binary").alias("value"))
    functions = settle(_functions(lines, sep, skip_rows))
    found = functions.filter("header is not null").orderBy("file").select("header").limit(1).collect()
    if not found:
        if functions.filter("start = 0 and ends[0]").isEmpty():
            return spark.createDataFrame([], schema or "Column_0 string")
        raise ValueError("no file's first record ends in its first block")
    cells = next(csv.reader([found[0]["header"].decode(encoding, "replace").removesuffix("\r")], delimiter=sep))
    names = _unmarked(cells) if header else [f"_c{i}" for i in range(len(cells))]
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema) if schema else T.StructType([T.StructField(c, T.StringType()) for c in names])
    entries = settle(_entries(functions))
    raw = _records(lines, entries, sep, skip_rows, header, not entries.filter("left").isEmpty())
    text = raw.select(_decoded(F.col("raw"), encoding).alias("t"))
    own = F.when(F.endswith("t", F.lit("\r")), F.col("t").substr(F.lit(1), F.length("t") - 1)).otherwise(F.col("t"))
    return text.select(F.from_csv(own, kind.toDDL(), {"sep": sep, "multiLine": "true", **READING}).alias("r")).select("r.*")


def _unmarked(names: list[str]) -> list[str]:
    """Without the mark that some programs put before a file's first character."""
    return [n.removeprefix("\ufeff") if i == 0 else n for i, n in enumerate(names)]


def _decoded(raw, encoding: str):
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return raw.cast("string")

    def run(raws):
        return raws.map(lambda r: None if r is None else bytes(r).decode(encoding, "replace"))

    return F.pandas_udf(run, "string")(raw)
