"""A farm's rows and a new file of rows: what is new, what comes again, and what cannot be the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_m

#: Metres from which two rows of one id are two rows.
FAR_APART = 50.0


def merge_counts(previous: DataFrame, incoming: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: incoming rows whose key is new, and those whose key was there."""
    old = previous.select(key).distinct().withColumn("_old", F.lit(True))
    return incoming.select(key).join(old, key, "left").agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count_if("_old").alias("repeated"))


def collisions(previous: DataFrame, incoming: DataFrame, lat0: float | None = None) -> DataFrame:
    """Incoming rows whose start lies over FAR_APART metres from that of the previous row of their id: row_id, distance.

    Of previous rows with one id the last counts. Distances are on the plane of `lat0`, by default the first previous row's latitude.
    """
    last = previous.groupBy("row_id").agg(F.max_by(F.struct("lat_a", "lon_a"), "row_ord").alias("_old"))
    if lat0 is None:
        first = previous.agg(F.min_by("lat_a", "row_ord").alias("_lat0"), F.lit(1).alias("_one"))
        last = last.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")  # first has one row
    else:
        last = last.withColumn("_lat0", F.lit(lat0))
    both = incoming.join(last, "row_id").withColumn("distance", distance_m(F.col("_old.lat_a"), F.col("_old.lon_a"), F.col("lat_a"), F.col("lon_a"), F.col("_lat0")))
    return both.where(F.col("distance") > FAR_APART).select("row_id", "distance")


def appended(before: DataFrame, added: DataFrame) -> DataFrame:
    """Records of a log and those that come after them; a column that only one side has is null in the other."""
    return before.unionByName(added, allowMissingColumns=True)


def offset_advice(lengths: DataFrame, layout, key: str | None = None, stated_mm: float = 0.0) -> DataFrame:
    """The stake offset that rows' lengths (metres) imply, on the whole or for each `key`: n, median, p10, p90, spread_mm, offset_mm.

    Also `suggest` (over 50 mm from `stated_mm`) and `uneven` (a spread over 500 mm). Order statistics are by number, found by
    counts of millimetres: equal lengths are counted first, and only lengths of the millimetre that holds a number are ranked.
    """
    from .tables import order_statistics

    keyed = lengths.withColumn("_key", F.lit(0) if key is None else F.col(key))
    stats = order_statistics(keyed, "_key", "length", width=0.001)
    out = stats.withColumns({"spread_mm": (F.col("p90") - F.col("p10")) * 1000, "offset_mm": (F.col("median") - layout.extent) * 500})
    out = out.withColumns({"suggest": F.abs(F.col("offset_mm") - stated_mm) > 50, "uneven": F.col("spread_mm") > 500})
    return out.drop("_key") if key is None else out.withColumnRenamed("_key", key)
