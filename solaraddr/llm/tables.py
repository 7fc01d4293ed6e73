"""Shared-folder tables and small session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that stand behind one part of an exchange, about.
PART_BYTES = 32 << 20
#: A lookup of at most this many short rows may be broadcast; beyond it the plain join runs.
BROADCAST_ROWS = 20_000
#: Spark's setting by which the shuffle files of a query go when it ends, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of this application in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/solaraddr-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors.

    The files that were shuffled for it go at once, as nothing reads them after the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more.

    Call it only when all that came from the tables is itself written: a lost executor then needs none of them.
    """
    home = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(home.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(texts: DataFrame, column: str = "text") -> int:
    """Parts of an exchange over `texts`: spark.sql.shuffle.partitions, or more where the text is long, so that a part stays small at any size."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-total // PART_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` for broadcast if it has at most `rows` rows; else leaves the join to the planner (which splits skewed keys)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    byte = "list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({x}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: {byte}, 4294967295), 4294967295)"
