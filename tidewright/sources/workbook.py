"""Spreadsheets (xlsx) as a data source of several tasks, and a sink for small tables.

A workbook is a zip of XML files.  A partition is a range of rows: its task streams the sheet's XML, skips to its rows, keeps
them until the range ends, and looks up only the shared strings that they name, in one pass over that file.  Nothing reads the
whole sheet into memory.  The driver reads the sheet's name, its size and, where no schema is given, the first `sample` rows.

Cells: numbers are doubles, dates (numbers in a date format) timestamps, then booleans and text; errors and empty cells are null,
and so is a cell that does not fit its column's type.  Text columns take the text of any cell.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import LoadError

FORMAT = "workbook"
#: Rows of a partition, rows that types are taken from, rows of an Arrow batch, and rows that a sheet can have.
RANGE, SAMPLE, BATCH, MOST_ROWS = 50_000, 100, 5_000, 1_048_576
# Numbers of the built-in formats that are dates, and the day that a serial number 0 stands for (usual, and of 1904).
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DAY0, DAY0_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
_LETTERS = re.compile("[A-Z]+")
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _open(path: str) -> zipfile.ZipFile:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return zipfile.ZipFile(system.open_input_file(inner))
    return zipfile.ZipFile(path.removeprefix("file://"))


def _elements(book: zipfile.ZipFile, member: str, *names: str) -> Iterator[ElementTree.Element]:
    """The elements of those names as they end; what has been seen is let go."""
    with book.open(member) as stream:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _local(e.tag) in names:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def _column(reference: str) -> int:
    out = 0
    for c in _LETTERS.match(reference)[0]:
        out = 26 * out + ord(c) - 64
    return out - 1


def _text(e: ElementTree.Element) -> str:
    """The text of a string item, without phonetic hints."""
    out = []
    for child in e:
        name = _local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [x.text or "" for x in child if _local(x.tag) == "t"]
    return "".join(out)


class Sheet:
    """One sheet of a workbook: where it is, which styles are dates, and its rows."""

    def __init__(self, path: str, sheet: str | None = None):
        try:
            self.book = _open(path)
            members = set(self.book.namelist())
            root = ElementTree.fromstring(self.book.read("xl/workbook.xml"))
            targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))}
        except (OSError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            raise LoadError(f"cannot read the workbook {path}: {str(e)[:200]}") from e
        sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if _local(k) == "id")) for e in root.iter() if _local(e.tag) == "sheet"]
        found = [t for name, t in sheets if sheet is None or name == sheet]
        if not found:
            raise LoadError(f"the workbook has no sheet {sheet!r}")
        target = targets[found[0]]
        self.member = target[1:] if target.startswith("/") else f"xl/{target}"
        self.strings = "xl/sharedStrings.xml" if "xl/sharedStrings.xml" in members else None
        pr = next((e for e in root.iter() if _local(e.tag) == "workbookPr"), None)
        self.day0 = DAY0_1904 if pr is not None and pr.get("date1904") in ("1", "true") else DAY0
        self.dates = self._date_styles() if "xl/styles.xml" in members else frozenset()

    def _date_styles(self) -> frozenset[int]:
        root = ElementTree.fromstring(self.book.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
        dated = {k for k, code in own.items() if re.search("[ymdhs]", _QUOTED.sub("", code), re.I)}
        formats = next((e for e in root.iter() if _local(e.tag) == "cellXfs"), [])
        return frozenset(k for k, e in enumerate(formats) if int(e.get("numFmtId", 0)) in dated | DATE_FORMATS)

    def last_row(self) -> int:
        """The last row by the sheet's own note of its size, else about, by the rows in its first 64 KB."""
        with self.book.open(self.member) as stream:
            start = stream.read(1 << 16)
        size = re.search(rb"<(?:\w+:)?dimension\b[^>]*\bref=.[A-Z]+\d+:[A-Z]+(\d+)", start)
        if size:
            return int(size[1])
        return self.book.getinfo(self.member).file_size * len(re.findall(rb"<(?:\w+:)?row\b", start)) // max(1, len(start))

    def rows(self, first: int, last: int | None) -> Iterator[tuple[int, dict[int, object]]]:
        """(row number from 1, column -> value) of rows first to last; shared strings are ("s", number) still."""
        number = 0
        for e in _elements(self.book, self.member, "row"):
            number = int(e.get("r") or number + 1)
            if last is not None and number > last:
                return
            if number >= first:
                yield number, self._cells(e)

    def _cells(self, row: ElementTree.Element) -> dict[int, object]:
        out, at = {}, -1
        for c in row:
            if _local(c.tag) != "c":
                continue
            at = _column(c.get("r")) if c.get("r") else at + 1
            value = self._value(c)
            if value is not None:
                out[at] = value
        return out

    def _value(self, c: ElementTree.Element) -> object:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_text(x) for x in c if _local(x.tag) == "is"), None)
        raw = next((x.text for x in c if _local(x.tag) == "v"), None)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return ("s", int(raw))
        if kind == "b":
            return raw.strip() in ("1", "true")
        if kind == "str":
            return raw
        if kind == "d":
            return dt.datetime.fromisoformat(raw.rstrip("Z"))
        number = float(raw)
        if int(c.get("s") or 0) in self.dates:
            return self.day0 + dt.timedelta(microseconds=round(number * 86_400_000_000))
        return number

    def resolved(self, rows: list[tuple[int, dict[int, object]]]) -> list[dict[int, object]]:
        """The rows with their shared strings, looked up by number in one pass."""
        wanted = {v[1] for _, cells in rows for v in cells.values() if isinstance(v, tuple)}
        found: dict[int, str] = {}
        if wanted and self.strings:
            most = max(wanted)
            for k, e in enumerate(_elements(self.book, self.strings, "si")):
                if k in wanted:
                    found[k] = _text(e)
                if k >= most:
                    break
        return [{at: found.get(v[1]) if isinstance(v, tuple) else v for at, v in cells.items()} for _, cells in rows]


def _fit(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
        return value.isoformat(" ") if isinstance(value, dt.datetime) else str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value if isinstance(value, dt.datetime) else None
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, dt.datetime) else None
    if not isinstance(value, float):
        return None
    return int(value) if isinstance(kind, T.IntegralType) else value


def _arrow(kind: T.DataType) -> pa.DataType:
    known = {T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DateType: pa.date32(), T.TimestampNTZType: pa.timestamp("us")}
    if type(kind) not in known:
        raise LoadError(f"a workbook has no columns of type {kind.simpleString()}")
    return known[type(kind)]


@dataclass
class Rows(InputPartition):
    first: int
    last: int | None


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.size = max(1, int(options.get("rows", RANGE)))

    def partitions(self) -> list[InputPartition]:
        last = min(Sheet(self.options["path"], self.options.get("sheet")).last_row(), MOST_ROWS)
        starts = list(range(2, max(3, last + 1), self.size))
        return [Rows(a, a + self.size - 1 if a != starts[-1] else None) for a in starts]  # the last one takes whatever follows

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        sheet = Sheet(self.options["path"], self.options.get("sheet"))
        arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema])
        held: list[tuple[int, dict[int, object]]] = []

        def batches() -> Iterator[pa.RecordBatch]:
            rows = sheet.resolved(held)
            for at in range(0, len(rows), BATCH):
                part = rows[at : at + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([_fit(r.get(k), f.dataType) for r in part], t.type) for k, (f, t) in enumerate(zip(self.schema, arrow))], schema=arrow)

        for row in sheet.rows(partition.first, partition.last):
            held.append(row)
            if len(held) >= max(self.size, BATCH):  # of an open last range
                yield from batches()
                held.clear()
        yield from batches()


class WorkbookSource(DataSource):
    """Options: path; sheet (a name, default the first); rows (of a partition); sample (rows that types are taken from)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        sheet = Sheet(self.options["path"], self.options.get("sheet"))
        head = sheet.resolved(list(sheet.rows(1, 1 + max(1, int(self.options.get("sample", SAMPLE))))))
        if not head or not head[0]:
            raise LoadError("the sheet has no header row")
        width, kinds = max(head[0]) + 1, {float: T.DoubleType(), bool: T.BooleanType(), dt.datetime: T.TimestampNTZType()}
        fields = []
        for k in range(width):
            seen = {type(r[k]) for r in head[1:] if r.get(k) is not None}
            fields.append(T.StructField(str(_fit(head[0].get(k), T.StringType()) or f"column_{k + 1}"), kinds.get(next(iter(seen)), T.StringType()) if len(seen) == 1 else T.StringType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(schema, self.options)


def read_workbook(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: object) -> DataFrame:
    """A sheet with a header row."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format(FORMAT).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
# The parts of a workbook of one sheet; style 1 is a date.
PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_DOC}/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook {_MAIN} xmlns:r="{_DOC}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": f'{_HEAD}<styleSheet {_MAIN}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _cell(v: object) -> str:
    if v is None or v != v:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.date):
        at = v.replace(tzinfo=None) if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return f'<c s="1"><v>{(at - DAY0) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def write_workbook(df: DataFrame, path: str, *order_by: str) -> None:
    """df as a workbook of one sheet, written by one task: a sheet holds a million rows, more are refused."""
    columns = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(inner, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in PARTS.items():
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                out.write(f"{_HEAD}<worksheet {_MAIN}><sheetData>".encode())
                out.write(f"<row>{''.join(map(_cell, columns))}</row>".encode())
                for batch in batches:
                    n += batch.num_rows
                    if n >= MOST_ROWS:
                        raise ValueError("a sheet holds fewer rows than this table has")
                    cells = [c.to_pylist() for c in batch.columns]
                    out.write("".join(f"<row>{''.join(map(_cell, r))}</row>" for r in zip(*cells)).encode())
                out.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    one = df.repartition(1)
    (one.sortWithinPartitions(*order_by) if order_by else one).mapInArrow(write, "n long").agg(F.sum("n")).collect()
