"""Fixes and photos that arrive as a stream, located batch by batch against rows that are compiled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compiled import Farm, compile_rows
from ..operators.locate import best_modules, near_compiled
from ..sources.photos import photo_stream


def locate_stream(fixes: DataFrame, rows: DataFrame, farm: Farm, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the best module of every fix to Parquet under `path`, in a folder for each batch, so that a batch run again replaces itself.

    The rows are compiled when the query starts and kept as a table beside the checkpoint, which all batches read.
    """
    kept = f"{checkpoint.rstrip('/')}.rows"
    compile_rows(rows, farm).write.mode("overwrite").parquet(kept)
    compiled = rows.sparkSession.read.parquet(kept)

    def put(batch: DataFrame, number: int) -> None:
        best_modules(near_compiled(batch, compiled, farm), farm).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = fixes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_photos(spark: SparkSession, folder: str, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Reads each photo that is dropped into `folder` once and appends a row for it (see `read_photos`) to Parquet under `path`."""
    writer = photo_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def fixes_of_photos(photos: DataFrame) -> DataFrame:
    """Located photos as fixes: their path is their id."""
    return photos.where(F.col("error").isNull()).select(F.col("path").alias("fix_id"), "file_name", "lat", "lon", "accuracy", "taken_at")
