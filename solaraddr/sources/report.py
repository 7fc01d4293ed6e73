"""A text document of many parts that appears at once: parts are written by tasks and joined when all of them are there."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    lines: int


class ReportSink(DataSource):
    """`df.write.format("report").option("header", ...).mode("overwrite").save(path)`: one text file of the lines of a one-column table.

    The lines come in the order of the table's partitions (order it first), after the header if there is one, with a line feed
    between lines and none at the end. The file is put in place by a rename, so a reader sees the old document or the new one;
    a write that fails leaves the old one. `path` lies in a folder that driver and executors share. The driver joins
    the parts as files, in fixed memory: a report is one document for people, so its size is that of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() != "string":
            raise ValueError("a report takes one column of text")
        return ReportWriter(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("header"), overwrite)


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, header: str | None, overwrite: bool):
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        self.path, self.header = path, header
        self.folder = f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        """One part, under a name of this attempt: an attempt that is given up is not among the messages."""
        os.makedirs(self.folder, exist_ok=True)
        file, lines = f"{self.folder}/{uuid.uuid4().hex}", 0
        with open(file, "w", encoding="utf-8", newline="") as out:
            for row in iterator:
                out.write(("\n" if lines else "") + (row[0] or ""))
                lines += 1
        return Part(TaskContext.get().partitionId(), file, lines)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        whole = f"{self.folder}/whole"
        with open(whole, "wb") as out:
            first = self.header is None
            if not first:
                out.write(self.header.encode())
            for part in sorted((m for m in messages if m and m.lines), key=lambda m: m.number):
                if not first:
                    out.write(b"\n")
                first = False
                with open(part.file, "rb") as some:
                    shutil.copyfileobj(some, out, 1 << 20)
            out.flush()
            os.fsync(out.fileno())
        os.replace(whole, self.path)
        shutil.rmtree(self.folder)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def write_document(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Writes ordered lines as one document, in place of one that is there."""
    lines.sparkSession.dataSource.register(ReportSink)
    out = lines.write.format("report").mode("overwrite")
    (out if header is None else out.option("header", header)).save(path)
