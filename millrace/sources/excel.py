"""Workbooks (xlsx), read and written with the standard library.

A workbook is a zip of XML and holds 1 048 576 rows of 16 384 columns a sheet at most. A folder of workbooks is a table of
any size: each task writes its own ones, and reads some of them; a path that ends in .xlsx is one workbook, and so one
task's. Only names and types of columns reach the driver. Files over READ_BYTES are refused.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import uuid
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.result import HardStop
from ..session import NUMERIC

#: Limits of the format, and bytes of a file that is read.
ROWS, COLUMNS, READ_BYTES = 1 << 20, 1 << 14, 256 << 20
EPOCH = dt.datetime(1899, 12, 30)
# Names in workbooks.
MAIN, RELS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE, TYPES = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
# The numbers of built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


class Workbook:
    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise HardStop(f"not an xlsx workbook: {e}") from e
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(f"{{{RELS}}}id")]) for s in book.iter(f"{{{MAIN}}}sheet")}
        self.texts = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in self._parts("xl/sharedStrings.xml", "si")]
        named = {int(f.get("numFmtId")): f.get("formatCode") for f in self._parts("xl/styles.xml", "numFmt")}
        is_date = lambda i: i in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", named.get(i, "").lower())))
        formats = next(self._parts("xl/styles.xml", "cellXfs"), ())
        self.dates = [is_date(int(x.get("numFmtId", 0))) for x in formats]

    def _parts(self, name: str, tag: str):
        return ET.fromstring(self.zip.read(name)).iter(f"{{{MAIN}}}{tag}") if name in self.zip.namelist() else iter(())

    def _value(self, cell):
        kind, v = cell.get("t", "n"), cell.findtext(f"{{{MAIN}}}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(v)]
        if kind in ("str", "d"):
            return v
        if kind == "b":
            return v == "1"
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return EPOCH + dt.timedelta(milliseconds=round(float(v) * 86_400_000))
        return int(v) if re.fullmatch(r"-?\d{1,18}", v) else float(v)

    def rows(self, sheet: str):
        """Lists of cells; rows that aren't there are empty lists."""
        at = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                for _ in range(at, int(row.get("r", at + 1)) - 1):
                    yield []
                at = int(row.get("r", at + 1))
                out: list = []
                for cell in row.iter(f"{{{MAIN}}}c"):
                    k = _column(re.match("[A-Z]*", cell.get("r", "")).group()) if cell.get("r") else len(out)
                    out += [None] * (k - len(out))
                    out.append(self._value(cell))
                row.clear()
                yield out


def _column(name: str) -> int:
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the workbooks there."""
    if not _exists(spark, path):
        raise HardStop("no workbook")
    found = spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".xlsx") | F.lit(path.lower().endswith(".xlsx")))
    size = found.agg(F.max("length").alias("most"), F.count("*").alias("n")).first()
    if not size["n"] or size["most"] > READ_BYTES:
        raise HardStop("no workbook" if not size["n"] else f"over {READ_BYTES >> 20} MB")
    return found.select("path", "content")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _each(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_buffer().to_pybytes()


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Of the first workbook, in their order."""
    def run(batches):
        for at, raw in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([list(Workbook(raw).sheets)], pa.list_(pa.string()))], names=["path", "sheets"])

    return list(_files(spark, path).mapInArrow(run, "path string, sheets array<string>").orderBy("path").first()["sheets"])


#: What the cells of a column are, from bool to text; numbers of both kinds are doubles, other mixtures text.
KINDS = {"boolean": (bool, pa.bool_()), "bigint": (int, pa.int64()), "double": (float, pa.float64()), "timestamp_ntz": (dt.datetime, pa.timestamp("us")), "string": (str, pa.string())}


def _kind(kinds: set[str]) -> str:
    return next(iter(kinds)) if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


class _Sheet:
    """The cells of a workbook's sheet below its header."""

    def __init__(self, raw: bytes, sheet: str | None, header: bool, skip_rows: int):
        self.book = Workbook(raw)
        if sheet is not None and sheet not in self.book.sheets:
            raise HardStop(f"no sheet {sheet!r}; there are {list(self.book.sheets)}")
        self.name, self.header, self.skip = sheet or next(iter(self.book.sheets)), header, skip_rows
        self.names = next(self._all(), []) if header else []

    def _all(self):
        return (r for i, r in enumerate(self.book.rows(self.name)) if i >= self.skip)

    def rows(self):
        out = self._all()
        if self.header:
            next(out, None)
        return out


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True, skip_rows: int = 0, n: int | None = None) -> DataFrame:
    """The named sheet, or the first one, of a workbook, or of all those of a folder, which must have the same header.

    Columns whose cells are all numbers, booleans or dates have that type, others are text; blank cells are null.
    """
    files = _files(spark, path)

    def look(batches):
        for at, raw in _each(batches):
            try:
                own, kinds = _Sheet(raw, sheet, header, skip_rows), []
                for r in own.rows():
                    kinds += [set() for _ in range(len(r) - len(kinds))]
                    for k, v in zip(kinds, r, strict=False):
                        if v is not None:
                            k.add(next(name for name, (t, _) in KINDS.items() if type(v) is t))
                told = [[None if v in (None, "") else str(v) for v in own.names], [sorted(k) for k in kinds], None]
            except HardStop as e:
                told = [[], [], str(e)]
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([told[0]], pa.list_(pa.string())), pa.array([told[1]], pa.list_(pa.list_(pa.string()))), pa.array([told[2]], pa.string())], names=["path", "names", "kinds", "error"])

    seen = files.mapInArrow(look, "path string, names array<string>, kinds array<array<string>>, error string").orderBy("path").collect()  # a row a workbook
    if bad := [r["error"] for r in seen if r["error"]]:
        raise HardStop(bad[0])
    if len({tuple(r["names"]) for r in seen}) > 1:
        raise HardStop("workbooks have different headers")
    names = [v if v is not None else f"Unnamed: {i}" for i, v in enumerate(seen[0]["names"])]
    wide = max([len(names), *(len(r["kinds"]) for r in seen)], default=0)
    names += [f"Column_{i}" if not header else f"Unnamed: {i}" for i in range(len(names), wide)]
    kinds = [_kind({k for r in seen for k in (r["kinds"][i] if i < len(r["kinds"]) else ())}) for i in range(wide)]

    def cells(batches):
        for _, raw in _each(batches):
            rows = _Sheet(raw, sheet, header, skip_rows).rows()
            while part := list(itertools.islice(rows, 4096)):
                cols = [[None if i >= len(r) or r[i] is None else KINDS[k][0](r[i]) if k in ("string", "double") else r[i] for r in part] for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k][1]) for c, k in zip(cols, kinds, strict=True)], names=[f"c{i}" for i in range(wide)])

    out = files.mapInArrow(cells, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names) if wide else spark.createDataFrame([], T.StructType())
    return out if n is None else out.limit(n)


def _cell(at: str, v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) != float("inf"):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c r="{at}" s="1"><v>{(v.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'


def workbook(names: list[str], rows, sheet: str, freeze: bool) -> bytes:
    """One sheet with a header."""
    out = io.BytesIO()
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if freeze else ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{part}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{part}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name={quoteattr(sheet[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{RELS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{xml}<worksheet xmlns="{MAIN}">{pane}<sheetData>'.encode())
            for i, row in enumerate(_with_header(names, rows), 1):
                f.write(f'<row r="{i}">{"".join(_cell(f"{_name(j)}{i}", v) for j, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_excel(df: DataFrame, path: str, sheet: str = "Data", freeze: bool = True, rows: int = ROWS - 1) -> None:
    """Workbooks of one sheet with a header row, which stays in view (freeze).

    A path that ends in .xlsx is one workbook, which one task writes; a table that its sheet can't hold is refused. Any
    other path is a folder, where each task writes a workbook, or another one after so many rows; what was there goes. A
    workbook gets its name when it is whole, by its place in the table, so attempts that are repeated do no harm.
    """
    single = path.lower().endswith(".xlsx")
    if len(df.columns) > COLUMNS or (single and df.limit(ROWS).count() >= ROWS):
        raise HardStop(f"a sheet holds {ROWS - 1} rows and {COLUMNS} columns; write a folder of workbooks, csv or parquet")
    keep = (*NUMERIC, T.BooleanType, T.TimestampType, T.TimestampNTZType)
    own = [F.col(f"`{f.name}`") if isinstance(f.dataType, keep) and not isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`").cast("timestamp_ntz" if isinstance(f.dataType, T.DateType) else "string") for f in df.schema]
    names, spark = df.columns, df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(at, True)
    uri = re.sub("^file:/+", "file:///", store.makeQualified(at).toString())
    most = min(rows, ROWS - 1)

    def run(batches):
        task, done, cells = TaskContext.get(), [], []
        fs, to = FileSystem.from_uri(uri)

        def put():
            name = to if single else f"{to}/part-{task.partitionId():05d}-{len(done):03d}.xlsx"
            tried = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(tried) as f:
                f.write(workbook(names, cells, sheet, freeze))
            fs.move(tried, name)
            done.append(name)
            cells.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cells.append(row)
                if len(cells) == most and not single:
                    put()
        if cells or (not done and task.partitionId() == 0):  # an empty table has a header
            put()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    FileSystem.from_uri(uri)[0].create_dir(FileSystem.from_uri(uri)[1] if not single else FileSystem.from_uri(uri)[1].rsplit("/", 1)[0], recursive=True)
    given = df.select(*own).toDF(*[f"c{i}" for i in range(len(names))])
    (given.coalesce(1) if single else given).mapInArrow(run, "file string").count()


def _with_header(names: list[str], rows):
    yield tuple(names)
    yield from rows
