"""Coordinate text, workbooks, string lists, documents and streams on small cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from solaraddr.functions.coords import parse_coordinate
from solaraddr.operators.compiled import Farm
from solaraddr.operators.sheets import build_rows, flag_labels, skip_summary
from solaraddr.operators.strings import canon_row, match_entries
from solaraddr.sources.documents import load_documents, save_documents
from solaraddr.sources.workbook import largest_sheet, read_workbooks
from solaraddr.streaming.locate import locate_stream


@pytest.mark.parametrize(
    ("text", "lat", "lon", "error"),
    [
        ("-33.8688, 151.2093", -33.8688, 151.2093, None),
        ("33°52'7.68\"S 151°12'33.48\"E", -33.8688, 151.2093, None),
        ("S 33 52 7.68  E 151 12 33.48", -33.8688, 151.2093, None),
        ("33 52.128 S, 151 12.558 E", -33.8688, 151.2093, None),
        ("151°12'33.48\"E 33°52'7.68\"S", -33.8688, 151.2093, None),
        ("48 51 24 N 2 21 3 E", 48.8566667, 2.3508333, None),
        ("-0 15 0 20 0 0", -0.25, 20.0, None),
        ("-33.5 S 20 E", 33.5, 20.0, None),
        ("33 30 15 200", 33.5, 18.3333333, "range"),
        ("1 2 3", None, None, "syntax"),
        ("1 2 3 4 S 5 E", None, None, "syntax"),
        ("27 60 S 10 E", None, None, "range"),
        ("", None, None, "syntax"),
        ("somewhere", None, None, "syntax"),
    ],
)
def test_coordinates(spark, text, lat, lon, error):
    c = spark.createDataFrame([(text,)], "t string").select(parse_coordinate(F.col("t")).alias("c")).first().c
    assert c.error == error
    if error is None:
        assert (c.lat, c.lon) == pytest.approx((lat, lon), abs=1e-6)
    else:
        assert c.lat is None and c.lon is None


def test_null_coordinate(spark):
    assert spark.createDataFrame([(None,)], "t string").select(parse_coordinate(F.col("t")).alias("c")).first().c is None


def _book(path, rows):
    cell = lambda v: f"<c t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>"
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets><sheet name='Empty' r:id='a'/><sheet name='Rows' r:id='b'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='a' Target='worksheets/s1.xml'/><Relationship Id='b' Target='worksheets/s2.xml'/></Relationships>")
        z.writestr("xl/worksheets/s1.xml", "<worksheet><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    _book(tmp_path / "a.xlsx", [["Block", "X"], ["01", 1.5], [None, 2]])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = read_workbooks(spark, str(tmp_path))
    got = {(r.sheet, r.ord): r.cells for r in rows.where("error IS NULL").collect()}
    assert got == {("Rows", 0): {"Block": "01", "X": "1.5"}, ("Rows", 1): {"Block": None, "X": "2"}}
    assert rows.where("error IS NOT NULL").count() == 1
    assert largest_sheet(rows).count() == 2


def test_flags_and_reasons(spark):
    schema = "ord long, start_x string, start_y string, end_x string, end_y string, block string, tracker string, tracker_row string, side string"
    rows = [(2, "1", "2", "1", "3", "b", "t", "Yes", None), (3, "1", "2", "1", "3", "b", "t", "NO", "n"), (4, "1", "2", "1", "3", "b", "t", "no", "n"), (5, "1", "2", "1", "2", "b", "t", None, None), (6, None, "2", "1", "2", None, "t", "", None)]
    built = build_rows(flag_labels(spark.createDataFrame(rows, schema)))
    got = {r.ord: (r.row_id, r.reason) for r in built.collect()}
    assert got == {2: ("b-t-motorizada", None), 3: ("b-t-esclava", None), 4: ("b-t-esclava#2", None), 5: (None, "same-point"), 6: (None, "missing-coordinates")}
    assert skip_summary(built.where("reason IS NOT NULL")).count() == 2
    assert build_rows(spark.createDataFrame([], schema)).count() == 0


def test_rows_are_paired_by_order(spark):
    entries = spark.createDataFrame([(0, "1", "33", "r1"), (1, "1", "34", "r3"), (2, "1", "34", "r2"), (3, "1", "35", "r9")], "ord long, block string, tracker string, label_row string")
    rows = spark.createDataFrame(
        [(0, "a", "1", "33", "motorizada"), (1, "b", "1", "34", "esclava"), (2, "c", "1", "34", "motorizada"), (3, "d", "1", "35", "motorizada"), (4, "e", "1", "35", "esclava")],
        "row_ord long, row_id string, block string, tracker string, label_row string",
    )
    assert {(r.tier, r.ord, r.row_id) for r in match_entries(entries, rows).collect()} == {(5, 0, "a"), (5, 1, "b"), (5, 2, "c")}
    assert {(r.ord, r.row_id) for r in match_entries(entries, rows, highest_first=True).collect()} == {(0, "a"), (1, "c"), (2, "b")}
    labels = spark.createDataFrame([("R1",), (" r2 ",), ("",), ("Esclava",)], "t string").select(canon_row(F.col("t"), ("R1",)))
    assert [r[0] for r in labels.collect()] == ["motorizada", "r2", None, "esclava"]


def test_documents_are_replaced_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "farms"), "farm_id string, version long"
    save_documents(spark.createDataFrame([("a", 1), ("b", 1)], schema), path, "farm_id")
    save_documents(spark.createDataFrame([("b", 2)], schema), path, "farm_id")
    assert [tuple(r) for r in load_documents(spark, path, schema, "farm_id").collect()] == [("a", 1), ("b", 2)]


def test_fixes_from_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "r0", -27.4, 152.7, -27.40058, 152.7, "south", 1, 1)], "row_ord long, row_id string, lat_a double, lon_a double, lat_b double, lon_b double, side string, pos int, pos_total int")
    spark.createDataFrame([("f", -27.4002, 152.7, 1.0)], "fix_id string, lat double, lon double, accuracy double").write.parquet(str(tmp_path / "in"))
    fixes = spark.readStream.schema("fix_id string, lat double, lon double, accuracy double").parquet(str(tmp_path / "in"))
    locate_stream(fixes, rows, Farm(lat=-27.4, lon=152.7), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(60)
    assert [(r.fix_id, r.row_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("f", "r0")]
