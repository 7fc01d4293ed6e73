"""Farms and inspections kept as JSON documents, one folder for each key; fixtures; sheets as text with separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import read_separated


def save_documents(docs: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """Writes documents into the folders of their keys; of a key that is there already only the new document stays.

    Of two documents of one key in `docs` the later by `order` stays; without an order both do.
    """
    if order is not None:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        docs = docs.withColumn("_last", last).where("_last = 1").drop("_last")
    kept = docs.withColumn("_key", F.col(key))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_key").json(path)


def delete_documents(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str) -> None:
    """Empties the folders of the keys in `keys` (one column, `key`); other documents are not touched."""
    gone = keys.select(F.col(key).alias("_key")).distinct()
    there = spark.read.schema(f"{schema}, _key string").json(path).join(gone, "_key", "left_semi").select("_key").distinct()
    # a line without any field is no document: load_documents skips it
    there.select("_key", F.lit(None).cast("string").alias("_gone")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_key").json(path)


def load_documents(spark: SparkSession, path: str, schema: str, order: str | None = None, descending: bool = False, where=None, key: str | None = None) -> DataFrame:
    """Documents under `path` with the given schema, those that fit `where` (such as one farm's), in order of a column if one is named (texts by locale).

    With `key` only the folder of that key is read: the key is the folder's name.
    """
    docs = spark.read.schema(f"{schema}, _key string").json(path)
    fields = docs.drop("_key").columns
    docs = docs.where(F.coalesce(*[F.col(c).cast("string") if not docs.schema[c].dataType.typeName() in ("struct", "array", "map") else F.to_json(c) for c in fields]).isNotNull())
    docs = docs if key is None else docs.where(F.col("_key") == key)
    docs = docs if where is None else docs.where(where)
    docs = docs.drop("_key")
    if order is None:
        return docs
    by = F.collate(order, "UNICODE") if docs.schema[order].dataType.typeName() == "string" else F.col(order)
    return docs.orderBy(by.desc() if descending else by.asc())


def exported(docs: DataFrame) -> DataFrame:
    """Each document as one text in a readable layout."""
    return docs.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def load_fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON fixtures under `path`, one a file, with their file; those whose name begins with an underscore are left out. Ordered by file."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path, pathGlobFilter="[!_]*.json", recursiveFileLookup=True)
    return docs.withColumn("file", F.input_file_name()).orderBy("file")


def read_text_sheets(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, sheet, ord, cells) of text files with a header line, such as CSV or TSV, read in splits; see `lines.read_separated`."""
    return read_separated(spark, path, separator)
