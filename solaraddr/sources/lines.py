"""Text with separators and a header line, read in splits: what a split cannot know alone comes from counts of the splits before it."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one output batch.
_BATCH = 4096
_PARSED = "path string, at long, place long, kind string, cells array<string>, piece string"
_SCHEMA = pa.schema([("path", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("cells", pa.list_(pa.string())), ("piece", pa.string())])


def _cells(text: str, separator: str) -> list[str]:
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=separator), [])


def _records(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    """Lines (path, start of the split, whether it begins inside quotes, line) -> rows, the header, and pieces of records that cross splits.

    row: its cells and its place among the split's own rows. head: the file's first record. open: what of a record is in the split
    where it begins, with the place that it takes there. rest: what of a record is in a later split; `whole` if the split holds no end of it.
    """
    split, lines, odd, place, first, out = None, [], False, 0, False, []

    def closed() -> None:
        """What is left at the end of a split."""
        nonlocal lines
        if split is not None and lines:
            out.append((*split, place, "open head" if first else "open" if not inside else "rest whole", None, "\n".join(lines)))
        lines = []

    inside = False  # lines so far belong to a record of an earlier split
    for batch in batches:
        for path, at, begins_inside, line in zip(*[c.to_pylist() for c in batch.columns]):
            if (path, at) != split:
                closed()
                split, place, first, inside, odd = (path, at), 0, at == 0, begins_inside, begins_inside
                if at == 0:
                    line = line.removeprefix("﻿")
            lines.append(line)
            odd ^= bool(line.count('"') & 1)
            if odd:
                continue
            text, lines = "\n".join(lines), []
            if inside:
                out.append((*split, -1, "rest", None, text))
                inside = False
                continue
            cells = _cells(text, separator)
            if first:
                out.append((*split, -1, "head", cells, None))
                first = False
            elif any(cells):
                out.append((*split, place, "row", cells, None))
                place += 1
            if len(out) >= _BATCH:
                yield _batch(out)
                out = []
    closed()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def read_separated(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, sheet, ord, cells) of files with a header line, such as CSV or TSV: cells from header to text, empty ones null.

    Rows are numbered from 0 in the order of their file, rows without any text passed over; of two cells under one header the later
    counts. Files are read in splits of spark.sql.files.maxPartitionBytes: a first pass counts quotes by split, which tells where a
    split begins inside a quoted cell, a second one reads rows; a row's number is its place in the split and the number of rows before
    it, both from sums over one line a split. Only records that cross splits are gathered, record by record. In a file
    with quotes inside of unquoted cells these have to come in pairs.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("path", "at").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("path", "at", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # one row a split: its lines stay where they are, in their order, as the small side is sent to them
    marked = lines.join(F.broadcast(inside), ["path", "at"], "left").select("path", "at", "inside", "value")
    parsed = marked.mapInArrow(lambda b: _records(b, separator), _PARSED)
    rows = parsed.where("kind = 'row'")
    # pieces: a record begins with an open one and takes the rests after it
    pieces = parsed.where("piece IS NOT NULL").withColumn("kind", F.when(F.col("kind").startswith("open"), F.col("kind")))
    order = Window.partitionBy("path").orderBy("at", F.col("kind").isNotNull())
    pieces = pieces.withColumn("record", F.count("kind").over(order))
    whole = pieces.groupBy("path", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "\n").alias("text"), F.min_by("at", F.struct("at")).alias("at"), F.max("place").alias("place"), F.max("kind").alias("kind"),
    )
    whole = whole.mapInPandas(lambda b: _parsed(b, separator), "path string, at long, place long, kind string, cells array<string>")
    heads = parsed.where("kind = 'head'").select("path", "cells").unionByName(whole.where("kind = 'open head'").select("path", "cells"))
    rows = rows.select("path", "at", "place", "cells").unionByName(whole.where("kind = 'open'").where(F.exists("cells", lambda c: c != "")).select("path", "at", "place", "cells"))
    own = rows.groupBy("path", "at").agg(F.count("*").alias("n"))
    starts = own.select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # of headers that repeat the last counts, as in a dictionary
    names = F.transform("cells", lambda h, i: F.struct(F.trim(h).alias("h"), i.alias("i")))
    heads = heads.select("path", names.alias("names"))
    heads = heads.select("path", F.filter("names", lambda n: (n["h"] != "") & ~F.exists("names", lambda m: (m["h"] == n["h"]) & (m["i"] > n["i"]))).alias("names"))
    out = rows.join(F.broadcast(starts), ["path", "at"]).join(heads, "path")
    there = F.filter("names", lambda n: n["i"] < F.size("cells"))
    cells = F.map_from_entries(F.transform(there, lambda n: F.struct(n["h"].alias("key"), F.nullif(F.get("cells", n["i"]), F.lit("")).alias("value"))))
    return out.select("path", F.element_at(F.split("path", "/"), -1).alias("sheet"), (F.col("start") + F.col("place")).alias("ord"), cells.alias("cells"))


def _parsed(batches, separator: str):
    for pdf in batches:
        pdf["cells"] = [_cells(t, separator) for t in pdf["text"]]
        yield pdf[["path", "at", "place", "kind", "cells"]]
