"""Files: workbooks with types, sheets as text in splits, reports as one document, stores with versions."""

import json
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from solaraddr.operators import report as R
from solaraddr.sources.report import write_document
from solaraddr.sources.workbook import register, text_cells, variant_cells


def book(path, sheets, styles="<styleSheet><numFmts><numFmt numFmtId='164' formatCode='yyyy\"d\"'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='2'/></cellXfs></styleSheet>"):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f"<sheet name='{n}' r:id='i{i}'/>" for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook xmlns:r='r'><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id='i{i}' Target='worksheets/s{i}.xml'/>" for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>shared</t></si></sst>")
        z.writestr("xl/styles.xml", styles)
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")


HEAD = "".join(f"<c t='inlineStr'><is><t>{h}</t></is></c>" for h in ("Name", "Size", "Ok", "Day", "Bad"))
ONE = f"<row r='1'>{HEAD}</row><row r='2'><c t='s'><v>0</v></c><c><v>1.50</v></c><c t='b'><v>1</v></c><c s='1'><v>45292.5</v></c><c t='e'><v>#N/A</v></c></row><row r='4'><c r='B4' s='3'><v>7</v></c><c r='D4' s='2'><v>1</v></c></row>"
TWO = f"<row><c/></row><row>{HEAD}</row><row><c t='str'><v>made</v></c></row>"


def test_workbook_source_keeps_types(spark, tmp_path):
    register(spark)
    book(tmp_path / "a.xlsx", {"One": ONE, "Two": TWO})
    book(tmp_path / "b.xlsm", {"One": f"<row>{HEAD}</row>"})
    (tmp_path / "c.xlsx").write_bytes(b"no zip" * 100)
    (tmp_path / "notes.txt").write_text("no workbook")
    df = spark.read.format("workbook").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4  # three sheets and a file that cannot be read
    rows = [r for r in df.collect() if r.error is None]
    first = rows[0].cells
    assert [(r.sheet, r.ord) for r in rows] == [("One", 0), ("One", 1)]
    assert [(first[k].kind, first[k].text) for k in ("Name", "Size", "Ok", "Day", "Bad")] == [("text", "shared"), ("number", "1.50"), ("boolean", "true"), ("date", "45292.5"), ("error", "#N/A")]
    assert (first["Size"].number, first["Ok"].flag, first["Day"].at) == (1.5, True, datetime(2024, 1, 1, 12))
    assert rows[1].cells["Name"] is None and rows[1].cells["Size"].kind == "number" and rows[1].cells["Day"].at == datetime(1899, 12, 31)
    assert [r.error for r in df.where("error IS NOT NULL").collect()] == ["BadZipFile"]
    kinds = variant_cells(df.where("ord = 0")).select(*[F.expr(f"schema_of_variant(cells['{k}'])").alias(k) for k in ("Name", "Size", "Ok", "Day")]).first()
    assert tuple(kinds) == ("STRING", "DOUBLE", "BOOLEAN", "TIMESTAMP_NTZ")
    assert text_cells(df.where("ord = 1")).first().cells == {"Name": None, "Size": "7", "Ok": None, "Day": "1", "Bad": None}


def test_workbook_source_reads_what_is_asked_for(spark, tmp_path):
    register(spark)
    book(tmp_path / "a.xlsx", {"One": ONE, "Two": TWO})
    load = spark.read.format("workbook").option("columns", json.dumps(["Name", "none"])).option("header_row", 2).option("sheets", json.dumps(["Two"]))
    df = load.load(str(tmp_path / "a.xlsx"))
    assert df.rdd.getNumPartitions() == 1 and [{k: v.text for k, v in r.cells.items()} for r in df.collect()] == [{"Name": "made"}]
    some = spark.read.format("workbook").load(str(tmp_path)).where("sheet = 'One'")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 2
    assert spark.read.format("workbook").load(str(tmp_path)).where("sheet = 'None'").count() == 0


def test_report_is_one_document(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    address = "struct<block: string, tracker: string, tracker_row: string, string_number: double, module: int, counted_from: string, confidence: double>"
    schema = f"fix_id long, file_name string, taken_at string, lat double, lon double, accuracy double, address {address}, module_fixed int, anomaly string, klass int, delta_t double, status string, note string, codes string"
    place = lambda i: ("04", "T,1" if i % 50 == 0 else "T1", None, 2.0, i % 28 + 1, "far-end" if i % 2 else "near-dc", 0.5)
    found = [(i, f"p{i}.jpg", "2026-01-02T03:04:05.000Z", -27.4, 152.7 + i * 1e-6, 1.5, place(i) if i % 5 else None, None, None, None, 3.0, "descartado" if i % 7 == 3 else "pendiente", 'says "hi"\nand ñ' if i % 30 == 0 else None, "a,b") for i in range(500)]
    df = spark.createDataFrame(found, schema).repartition(7)
    R.write_report(df, path)

    def cell(v):
        s = "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in '",;\n') else s

    lines = [",".join(R.CSV_COLUMNS)]
    for i, name, at, lat, lon, acc, a, fixed, anomaly, klass, delta, status, note, codes in found:
        if status != "descartado":
            said = [None] * 6 if a is None else [*a[:5], "caja DC" if a[5] == "near-dc" else "punta lejana"]
            lines.append(",".join(map(cell, [name, at, f"{lat:.7f}", f"{lon:.7f}", acc, *said, fixed, None if a is None else "50%", anomaly, klass, delta, status, note, codes.replace(",", " ")])))
    assert open(path, "rb").read() == "\n".join(lines).encode()
    assert os.listdir(tmp_path) == ["report.csv"]


def test_a_report_that_fails_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "r.txt")
    lines = spark.range(100, numPartitions=4).select(F.format_string("line %d", "id").alias("line"), "id")
    write_document(lines.orderBy("id").select("line"), path)
    old = open(path).read()
    assert old == "\n".join(f"line {i}" for i in range(100))
    with pytest.raises(Exception, match="stop here"):
        write_document(lines.select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop here"))).otherwise(F.col("line")).alias("line")), path, "head")
    assert open(path).read() == old and os.listdir(tmp_path) == ["r.txt"]
    write_document(lines.limit(0).select("line"), path, "head")
    assert open(path).read() == "head"
    with pytest.raises(Exception, match="one column"):
        write_document(lines, path)


def one_task(text, separator):
    import csv
    import io

    lines = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=separator)
    head = [h.strip() for h in next(lines, [])]
    return [{h: v or None for h, v in zip(head, line, strict=False) if h} for line in lines if any(line)]


def test_separated_text_in_splits(spark, tmp_path):
    """Splits of a few bytes, cells that cross several of them, and the numbers of a single reader."""
    from solaraddr.sources.lines import read_separated

    texts = {
        "a.csv": "﻿id,Name ,text,id\n" + "".join(f'{i},n{i},"line {i}\nand ""more"", {"x" * (i % 90)}\n\nend",{i}b\n' if i % 7 == 0 else f"{i},n{i},plain,\n" if i % 5 else ",,,\n" for i in range(300)),
        "b.csv": '"a header\nof two lines",b\n1,2\n' + '"' + "long\n" * 200 + '",3\n4',
        "c.csv": "only,a,header\n", "d.csv": "", "e.csv": "x,y\r\n1,2\r\n3,4\r\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_separated(spark, str(tmp_path)).collect()
            for name, text in texts.items():
                mine = sorted((r for r in rows if r.sheet == name), key=lambda r: r.ord)
                want = one_task(text, ",")
                assert [r.ord for r in mine] == list(range(len(want))), (name, size)
                assert [r.cells for r in mine] == want, (name, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_store_keeps_versions(spark, tmp_path):
    from solaraddr.sources.store import ConflictError, Store

    path, schema = str(tmp_path / "store"), "farm_id string, name string, version long, note struct<a: int>"
    docs = lambda *rows: spark.createDataFrame(rows, schema)
    store = Store(spark, path, schema, "farm_id")
    assert store.load().count() == 0 and store.versions() == []
    assert store.save(docs(("a", "Zürich", 1, (1,)), ("b", "éclair", 1, None), ("b", "later", 2, None), (None, "no key", 1, None)), order="version") == 1
    assert store.save(docs(("a", "Zürich", 2, None), ("c", "Eden", 1, (2,)))) == 2
    assert store.delete(spark.createDataFrame([("b",), ("none",)], "farm_id string")) == 3
    got = lambda **k: {(r.farm_id, r.version) for r in store.load(**k).collect()}
    assert got() == {("a", 2), ("c", 1), (None, 1)} and got(version=1) == {("a", 1), ("b", 2), (None, 1)} and got(key="a") == {("a", 2)} and got(key="b") == set()
    assert got(where="version > 1") == {("a", 2)}
    # a write that fails, and one that is overtaken
    bad = docs(("a", "x", 9, None)).withColumn("name", F.raise_error(F.lit("stop here")))
    with pytest.raises(Exception, match="stop here"):
        store.save(bad)
    assert store.versions() == [1, 2, 3] and got() == {("a", 2), ("c", 1), (None, 1)}
    with pytest.raises(ConflictError):
        store._commit(store.manifest(2), [])
    assert not [f for f in os.listdir(f"{path}/versions") if f.startswith(".") and not f.endswith(".crc")]
    # compaction: the same documents in one table; then nothing of deleted keys is left
    assert store.compact() == 4 and got() == {("a", 2), ("c", 1), (None, 1)} and got(version=2) >= {("b", 2)}
    assert store.compact() == 4 and store.vacuum() >= 3 and store.versions() == [4] and len(os.listdir(f"{path}/data")) == 1
    assert got() == {("a", 2), ("c", 1), (None, 1)} and spark.read.option("recursiveFileLookup", True).parquet(f"{path}/data").where("farm_id = 'b'").count() == 0
    with pytest.raises(KeyError):
        store.load(version=2)
    assert store.save(docs(("d", "Eden", 1, None))) == 5 and store.load(order="farm_id").count() == 4


def test_store_orders_by_locale(spark, tmp_path):
    from solaraddr.sources.store import Store

    store = Store(spark, str(tmp_path / "names"), "id long, name string", "id")
    names = ["zeta", "Ñandú", "nube", "Álamo", "alba", "Eden", "élan", "ola"]
    store.save(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    assert [r.name for r in store.load(order="name").collect()] == ["Álamo", "alba", "Eden", "élan", "Ñandú", "nube", "ola", "zeta"]
    assert [r.name for r in store.load(order="name", descending=True).collect()][0] == "zeta"
