"""Workbooks in row ranges and the durable catalogue."""

import datetime as dt
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.errors import ConflictingWrite, LoadError, UnknownDataset
from tidewright.queries import QUERIES
from tidewright.sources import readers, workbook
from tidewright.sources.catalogue import Catalogue

HEAD = workbook._HEAD
MAIN = workbook._MAIN


def book(path, sheet, strings=(), formats=('<xf numFmtId="0"/>', '<xf numFmtId="164"/>'), own='<numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>', pr=""):
    parts = dict(workbook.PARTS)
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace("<sheets>", f"{pr}<sheets>")
    parts["xl/styles.xml"] = f"{HEAD}<styleSheet {MAIN}><numFmts>{own}</numFmts><cellXfs>{''.join(formats)}</cellXfs></styleSheet>"
    parts["xl/worksheets/sheet1.xml"] = f"{HEAD}<worksheet {MAIN}>{sheet}</worksheet>"
    if strings:
        parts["xl/sharedStrings.xml"] = f"{HEAD}<sst {MAIN}>{''.join(strings)}</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return str(path)


@pytest.fixture
def mixed(tmp_path):
    strings = ["<si><t>date</t></si>", "<si><t>target</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>", "<si><t xml:space='preserve'> a &amp; b </t></si>"]
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>note</t></is></c><c r="E1" t="str"><v>flag</v></c></row>']
    rows += ['<row r="2"><c r="A2" s="1"><v>44562</v></c><c r="B2"><v>1.5</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="b"><v>1</v></c></row>']
    rows += ['<row r="5"><c r="A5" s="1"><v>44563.5</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="D5" t="s"><v>3</v></c></row>', '<row><c s="1"><v>44564</v></c><c><f>1+1</f><v>2</v></c><c/><c><v>7</v></c></row>']
    return book(tmp_path / "mixed.xlsx", f'<dimension ref="A1:E6"/><sheetData>{"".join(rows)}</sheetData>', strings)


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_cells_of_every_kind(spark, mixed, rows):
    df = workbook.read_workbook(spark, mixed, rows=rows)
    assert df.dtypes == [("date", "timestamp_ntz"), ("target", "double"), ("column_3", "string"), ("note", "string"), ("flag", "boolean")]
    day = dt.datetime(2022, 1, 1)
    assert sorted(map(tuple, df.collect())) == [(day, 1.5, None, "rich", True), (day + dt.timedelta(1.5), None, None, " a & b ", None), (day + dt.timedelta(2), 2.0, None, "7", None)]
    assert df.rdd.getNumPartitions() == {1: 5, 2: 3, 100: 1}[rows]


def test_a_given_schema_and_the_days_of_1904(spark, mixed, tmp_path):
    out = workbook.read_workbook(spark, mixed, "a date, b long, c string, d string").orderBy("a").collect()
    assert [tuple(r) for r in out][0] == (dt.date(2022, 1, 1), 1, None, "rich")
    old = book(tmp_path / "old.xlsx", '<sheetData><row><c t="str"><v>d</v></c></row><row><c s="1"><v>1</v></c></row></sheetData>', pr='<workbookPr date1904="1"/>')
    assert workbook.read_workbook(spark, old).first()[0] == dt.datetime(1904, 1, 2)


def test_no_workbook(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("no zip")
    for path in ("x.xlsx", "missing.xlsx"):
        with pytest.raises(LoadError):
            readers.load(spark, str(tmp_path / path)).collect()
    empty = book(tmp_path / "empty.xlsx", "<sheetData/>")
    with pytest.raises(LoadError):
        readers.load(spark, empty)
    with pytest.raises(LoadError):
        readers.load(spark, empty, sheet="other")


def test_written_workbooks_come_back(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") / 3).alias("y"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("date"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("<é & "), F.col("id").cast("string"))).alias("name"), (F.col("id") % 2 == 0).alias("even"))
    path = str(tmp_path / "w" / "out.xlsx")
    workbook.write_workbook(df, path, "id")
    back = workbook.read_workbook(spark, path, "id long, y double, date timestamp_ntz, name string, even boolean", rows=300)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    name = readers.upload(spark, path)
    assert name == "out" and readers.resolve(spark, "out").count() == 1000 and readers.drop(spark, "out")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    store = Catalogue(spark, f"file://{tmp_path}/store")
    one, two = spark.createDataFrame([(1, "a")], "x long, y string"), spark.createDataFrame([(2.5,)], "z double")
    assert store.names() == [] and store.put("sales/2024 é.x", one) == 1 and store.put("sales/2024 é.x", two) == 2
    assert store.names() == ["sales/2024 é.x"] and store.versions("sales/2024 é.x") == [(1, 1), (2, 1)]
    again = Catalogue(spark, f"file://{tmp_path}/store")  # nothing is held in the object
    assert rows_of(again.get("sales/2024 é.x")) == [(2.5,)] and rows_of(again.get("sales/2024 é.x", 1)) == [(1, "a")]
    assert again.put("empty", one.limit(0)) == 1 and again.get("empty").columns == ["x", "y"]
    assert again.drop("empty") and not again.drop("empty") and again.names() == ["sales/2024 é.x"]
    for name, version in (("empty", None), ("nothing", None), ("sales/2024 é.x", 9)):
        with pytest.raises(UnknownDataset):
            again.get(name, version)


def test_failed_writes_are_never_seen(spark, tmp_path):
    store = Catalogue(spark, f"file://{tmp_path}/store")
    broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    with pytest.raises(Exception):
        store.put("a", broken)
    assert store.names() == [] and store.versions("a") == []
    store.put("a", spark.range(3))
    with pytest.raises(Exception):
        store.put("a", broken)
    assert store.versions("a") == [(1, 3)] and store.get("a").count() == 3


def test_two_writers(spark, tmp_path):
    store = Catalogue(spark, f"file://{tmp_path}/store")
    store.put("a", spark.range(1))
    with pytest.raises(ConflictingWrite):
        store.put("a", spark.range(2), expected=0)
    assert not store._commit("a", 1, {"data": "other"}) and store.get("a").count() == 1  # a number that is taken stays as it is
    writers = [threading.Thread(target=lambda k=k: Catalogue(spark, f"file://{tmp_path}/store").put("a", spark.range(k + 2))) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    told = store.versions("a")
    assert [v for v, _ in told] == [1, 2, 3, 4, 5] and sorted(n for _, n in told[1:]) == [2, 3, 4, 5]
    assert store.put("a", spark.range(9), expected=5) == 6


def test_durable_names_of_the_readers(spark):
    readers.put(spark, "kept", spark.range(4), durable=True)
    assert "kept" in readers.list_datasets(spark) and readers.resolve(spark, "kept").count() == 4
    readers.put(spark, "kept", spark.range(2))  # the session's own name comes first
    assert readers.resolve(spark, "kept").count() == 2 and readers.drop(spark, "kept") and readers.resolve(spark, "kept").count() == 4
    assert readers.drop(spark, "kept") and not readers.drop(spark, "kept")


def test_csv_keeps_microseconds_and_white_space(spark, tmp_path):
    at = dt.datetime(2024, 3, 10, 2, 30, 0, 1)
    made = [(k, at + dt.timedelta(microseconds=k), at.replace(tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=k), text) for k, text in enumerate((" a ", "b\t", "c,d", 'e "f"'))]
    df = spark.createDataFrame(made, "k long, ntz timestamp_ntz, ltz timestamp, s string")
    readers.write_csv(df, str(tmp_path / "x.csv"))
    assert rows_of(readers.load_csv(spark, str(tmp_path / "x.csv"), df.schema)) == rows_of(df)


def test_csv_round_trip_within_a_millisecond(spark, tmp_path):
    """Rows of one type a microsecond apart are rows of their own."""
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 0.000001)").alias("ts"), F.concat(F.lit("t"), F.col("id") % 2).alias("event_type"), (F.col("id") / 100).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert rows_of(QUERIES["csv_round_trip"](spark, str(tmp_path))) == [("t0", 1000, 9990.0), ("t1", 1000, 10000.0)]
