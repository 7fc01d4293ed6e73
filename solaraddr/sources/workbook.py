"""Spreadsheet files (.xlsx, .xlsm): every sheet's rows as maps from header to text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

_BATCH = 2000
# The built-in number formats that are dates or times.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: What a file that is no workbook, or a damaged one, may raise.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration, OSError)
CELL = "struct<kind: string, text: string, number: double, flag: boolean, at: timestamp_ntz>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


class Book:
    """A workbook that is open: its sheets in order, and their lines as a stream of typed cells. Only the parts that are asked for are read."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = set(self.zip.namelist())
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in self._part("_rels/workbook.xml.rels")}
        book = self._part("workbook.xml")
        self.sheets: list[tuple[str, str]] = []
        self.epoch = datetime(1899, 12, 30)
        for n in book.iter():
            if _local(n.tag) == "sheet":
                self.sheets.append((n.get("name"), targets[next(v for k, v in n.attrib.items() if _local(k) == "id")]))
            elif _local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)

    def _part(self, name: str):
        return ElementTree.fromstring(self.zip.read(f"xl/{name}"))

    def shared(self) -> list[str]:
        return [_text(si) for si in self._part("sharedStrings.xml") if _local(si.tag) == "si"] if "xl/sharedStrings.xml" in self.names else []

    def dated(self) -> set[int]:
        """The styles that show a number as a date or a time."""
        if "xl/styles.xml" not in self.names:
            return set()
        styles, own, out = self._part("styles.xml"), {}, set()
        for n in styles.iter():
            if _local(n.tag) == "numFmt":
                own[int(n.get("numFmtId"))] = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", n.get("formatCode") or "")
        for group in styles:
            if _local(group.tag) == "cellXfs":
                for i, xf in enumerate(group):
                    number = int(xf.get("numFmtId") or 0)
                    if number in DATES or re.search("[dmyhs]", own.get(number, ""), re.I):
                        out.add(i)
        return out

    def lines(self, target: str, shared: list[str], dated: set[int]) -> Iterator[tuple[int, dict[int, tuple]]]:
        """(line from 1, cells by column) of every line that holds a cell; a cell is (kind, text as stored, value)."""
        line = 0
        with self.zip.open(f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if _local(row.tag) != "row":
                    continue
                line, cells = int(row.get("r", line + 1)), {}
                for at, c in enumerate(row):
                    if (cell := self._cell(c, shared, dated)) is not None:
                        cells[_column(c.get("r", "")) if c.get("r") else at] = cell
                row.clear()
                if cells:
                    yield line, cells

    def _cell(self, c, shared: list[str], dated: set[int]) -> tuple | None:
        text, kind = next((v.text for v in c if _local(v.tag) == "v"), None), c.get("t")
        if kind == "inlineStr":
            return "text", (t := _text(c)), t
        if text is None:
            return None
        if kind == "s":
            return "text", (t := shared[int(text)]), t
        if kind == "b":
            return "boolean", "true" if text == "1" else "false", text == "1"
        if kind in ("str", "e"):
            return "error" if kind == "e" else "text", text, text
        if kind == "d":
            return "date", text, datetime.fromisoformat(text.removesuffix("Z"))
        number = float(text)
        if int(c.get("s") or 0) in dated:
            return "date", text, self.epoch + timedelta(milliseconds=round(number * 86_400_000))
        return "number", text, number


def _rows(lines: Iterator[tuple[int, dict[int, tuple]]], header_row: int) -> Iterator[tuple[int, dict[str, tuple | None]]]:
    """Rows under the headers of a line, numbered from 0: cells by header, null where empty; lines without any are passed over."""
    headers, place = {}, 0
    for line, cells in lines:
        if line == header_row:
            headers = {k: v[1].strip() for k, v in cells.items() if v[1].strip()}
        elif line > header_row:
            own = {h: cells.get(k) for k, h in headers.items()}
            if any(v is not None for v in own.values()):
                yield place, own
                place += 1


def read_workbooks(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """(path, sheet, sheet_ord, ord, cells, error) of the files under `path`, one task input a file; empty cells are null, cells without a header are left out.

    Headers come from line `header_row`; later lines are rows, numbered from 0. A file that cannot be read is one row with its error. Cells
    come as text as they are stored; the source `workbook` gives them with types, a task a sheet. A file is read whole by one task, so it has to fit its memory.
    """

    def parse(batches):
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    book = Book(io.BytesIO(bytes(raw)))
                    shared = book.shared()
                    for number, (sheet, target) in enumerate(book.sheets):
                        for place, own in _rows(book.lines(target, shared, set()), header_row):
                            rows.append((name, sheet, number, place, {h: v and v[1] for h, v in own.items()}, None))
                            if len(rows) >= _BATCH:
                                yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_ord", "ord", "cells", "error"])
                                rows = []
                except BROKEN as problem:
                    rows.append((name, None, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_ord", "ord", "cells", "error"]).astype({"sheet_ord": "Int32", "ord": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sheet string, sheet_ord int, ord long, cells map<string,string>, error string")


def largest_sheet(rows: DataFrame) -> DataFrame:
    """The rows of each file's sheet with most rows, the first of equal ones."""
    sizes = rows.where("sheet IS NOT NULL").groupBy("path", "sheet_ord").count()
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("count"), "sheet_ord"))
    return rows.join(sizes.withColumn("_i", first).where("_i = 1").select("path", "sheet_ord"), ["path", "sheet_ord"], "left_semi")


@dataclass
class SheetPart(InputPartition):
    """A sheet of a file; of a file that cannot be read, its error."""

    path: str
    sheet: str | None
    number: int | None
    target: str | None
    error: str | None = None


class WorkbookSource(DataSource):
    """`spark.read.format("workbook").load(path)` after `register`: path, sheet, sheet_ord, ord, cells (header to CELL) and error.

    A file, a folder of .xlsx and .xlsm files, or a URI that Arrow's file systems know. Each sheet is a partition, and reads only its own
    part of the file. Options: header_row (1), columns (a JSON list of headers: no other cell is kept), sheets (a JSON list: no other
    sheet is read). Conditions on path and sheet leave partitions out.
    A cell's kind is text, number, boolean, date or error; `text` is what is stored, and one of the others holds the value.
    Empty cells are null. A file that cannot be read is one row with its error, and a sheet that breaks off ends with one.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return f"path string, sheet string, sheet_ord int, ord long, cells map<string, {CELL}>, error string"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.header_row = options["path"], int(options.get("header_row", 1))
        self.columns, self.sheets = (set(json.loads(options[k])) if k in options else None for k in ("columns", "sheets"))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("sheet",)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], some) & some
            else:
                yield f

    def _files(self):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, at

    def partitions(self) -> list[SheetPart]:
        from pyarrow import fs

        system, at = self._files()
        found = system.get_file_info([at])[0]
        files = [found.path] if found.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.extension in ("xlsx", "xlsm")]
        out = []
        for path in sorted(files):
            if path not in self.wanted.get("path", {path}):
                continue
            try:
                with system.open_input_file(path) as f:
                    out += [SheetPart(path, sheet, i, target) for i, (sheet, target) in enumerate(Book(f).sheets) if sheet in (self.sheets or {sheet}) and sheet in self.wanted.get("sheet", {sheet})]
            except BROKEN as problem:
                if "sheet" not in self.wanted:
                    out.append(SheetPart(path, None, None, None, type(problem).__name__))
        return out or [SheetPart("", None, None, None)]

    def read(self, part: SheetPart):
        if part.target is None:
            if part.error:
                yield part.path, None, None, None, None, part.error
            return
        system, _ = self._files()
        try:
            with system.open_input_file(part.path) as f:
                book = Book(f)
                for place, own in _rows(book.lines(part.target, book.shared(), book.dated()), self.header_row):
                    yield part.path, part.sheet, part.number, place, {h: self._typed(v) for h, v in own.items() if self.columns is None or h in self.columns}, None
        except BROKEN as problem:
            yield part.path, part.sheet, part.number, None, None, type(problem).__name__

    @staticmethod
    def _typed(cell: tuple | None) -> dict | None:
        if cell is None:
            return None
        kind, text, value = cell
        field = {"number": "number", "boolean": "flag", "date": "at"}.get(kind)
        return {"kind": kind, "text": text, "number": None, "flag": None, "at": None} | ({field: value} if field else {})


def register(spark: SparkSession) -> None:
    """Makes the formats `workbook` and `report` known to a session, and lets Python sources take conditions, which `workbook` needs."""
    from .report import ReportSink

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(ReportSink)


def variant_cells(rows: DataFrame) -> DataFrame:
    """Cells as VARIANT: a number, a text, a boolean or a timestamp each; errors are their text."""
    number = lambda c: F.when(c["kind"] == "number", c["number"].cast("variant")).when(c["kind"] == "boolean", c["flag"].cast("variant")).when(c["kind"] == "date", c["at"].cast("variant"))
    return rows.withColumn("cells", F.transform_values("cells", lambda _, c: number(c).when(c.isNotNull(), c["text"].cast("variant"))))


def text_cells(rows: DataFrame) -> DataFrame:
    """Cells as the text that is stored, as `read_workbooks` gives them."""
    return rows.withColumn("cells", F.transform_values("cells", lambda _, c: c["text"]))
