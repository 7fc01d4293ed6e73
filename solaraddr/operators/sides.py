"""Sides of the road and chains on one DC box, from the places of rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import to_local
from .tables import METRES, largest_gap, order_statistics, ranked


def along_axis(rows: DataFrame, key: str, order: str = "row_ord") -> DataFrame:
    """Adds, for the rows of each `key`, their middle along and across the common axis (metres, on the plane of the group's first row) and length.

    The axis is the mean of the rows' directions, each turned north. Groups are blocks or DC boxes; sums are taken per group.
    """
    first = rows.groupBy(key).agg(F.min_by(F.struct("lat_a", "lon_a"), order).alias("_o"))
    out = rows.join(first, key)
    ax, ay = to_local(F.col("lat_a"), F.col("lon_a"), F.col("_o.lat_a"), F.col("_o.lon_a"))
    bx, by = to_local(F.col("lat_b"), F.col("lon_b"), F.col("_o.lat_a"), F.col("_o.lon_a"))
    out = out.withColumns({"_ax": ax, "_ay": ay, "_bx": bx, "_by": by})
    out = out.withColumn("length", F.hypot(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")))
    sign, whole = F.when(F.col("_by") >= F.col("_ay"), 1).otherwise(-1), F.coalesce(F.nullif("length", F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({"_ux": (F.col("_bx") - F.col("_ax")) / whole * sign, "_uy": (F.col("_by") - F.col("_ay")) / whole * sign})
    axis = out.groupBy(key).agg(F.sum("_ux").alias("_sx"), F.sum("_uy").alias("_sy"))
    norm = F.coalesce(F.nullif(F.hypot("_sx", "_sy"), F.lit(0.0)), F.lit(1.0))
    axis = axis.select(key, (F.col("_sx") / norm).alias("axis_x"), (F.col("_sy") / norm).alias("axis_y"))
    mx, my = (F.col("_ax") + F.col("_bx")) / 2, (F.col("_ay") + F.col("_by")) / 2
    out = out.join(axis, key).withColumns({"along": mx * F.col("axis_x") + my * F.col("axis_y"), "across": my * F.col("axis_x") - mx * F.col("axis_y")})
    return out.drop("_o", "_ax", "_ay", "_bx", "_by", "_ux", "_uy")


def _medians(rows: DataFrame, key: str, name: str) -> DataFrame:
    return order_statistics(rows, key, "length", width=0.001).select(key, F.col("median").alias(name))


def side_report(rows: DataFrame, key: str = "block", order: str = "row_ord") -> tuple[DataFrame, DataFrame]:
    """Which rows lie south and which north of a road, and what each block looks like: (rows with `derived_side`, report).

    Rows are split at the widest step between neighbours along the axis (the first of equal ones). Report: block, rows, status,
    gap, lower, upper. Status: ambiguo (fewer than two rows), un-solo-lado (the step is below half the median length),
    escalonado (below 0.95 of the mean of both groups' median lengths: no road fits between), dos-lados. Only the last gives sides.
    Places, steps and medians come by stretches of the axis and by counts, so no block is one task's.
    """
    placed = along_axis(rows, key, order)
    numbered = ranked(placed, key, F.floor(F.col("along") / METRES), "along", order, name="_place")
    cut = placed.groupBy(key).agg(F.count("*").alias("rows")).join(largest_gap(placed, key, F.col("along"), order).withColumnRenamed("at", "_at"), key, "left")
    parted = numbered.join(cut.select(key, "_at"), key).withColumn("_upper", F.col("_place") > F.col("_at"))
    halves = _medians(parted.withColumn("_part", F.struct(key, "_upper")), "_part", "_half").select(F.col(f"_part.{key}").alias(key), "_half").groupBy(key).agg(F.avg("_half").alias("_facing"))
    sizes = parted.groupBy(key).agg(F.count_if(~F.col("_upper")).alias("lower"), F.count_if("_upper").alias("upper"))
    report = cut.join(_medians(placed, key, "_median"), key).join(halves, key).join(sizes, key)
    status = F.when(F.col("rows") < 2, "ambiguo").when(~(F.col("gap") > 0) | (F.col("gap") < 0.5 * F.col("_median")), "un-solo-lado")
    status = status.when(F.col("gap") < 0.95 * F.col("_facing"), "escalonado").otherwise("dos-lados")
    report = report.withColumn("status", status)
    sides = parted.join(report.select(key, "status"), key)
    derived = F.when(F.col("status") == "dos-lados", F.when(F.col("_upper"), "north").otherwise("south"))
    return sides.withColumn("derived_side", derived).drop("_place", "_total", "_at", "_upper"), report.select(key, "rows", "status", "gap", "lower", "upper")


def with_sides(rows: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows with the derived side (row_id, derived_side) where there is one, else their own."""
    return rows.join(derived.select("row_id", "derived_side"), "row_id", "left").withColumn("side", F.coalesce("derived_side", "side")).drop("derived_side")


def chain_report(rows: DataFrame, key: str = "dc_box", order: str = "row_ord") -> tuple[DataFrame, DataFrame]:
    """The place of each row in the chain of its DC box, and each box's shape: (row_id, pos, pos_total), report.

    Rows behind each other along their axis (over more than half their mean length and wider than across it) are a chain
    (cadena), counted from the south; rows beside each other (paralelas) are chains of one; else (mixta) there is no place. A box
    of one row is a chain. Rows without a box are left out. Places come by stretches of the axis, so no box is one task's.
    """
    placed = along_axis(rows.where(F.col(key).isNotNull()), key, order)
    spread = lambda c: F.max(c) - F.min(c)
    boxes = placed.groupBy(key).agg(F.count("*").alias("rows"), spread("along").alias("along_m"), spread("across").alias("across_m"), F.avg("length").alias("_mean"))
    chain = (F.col("rows") == 1) | ((F.col("along_m") > 0.5 * F.col("_mean")) & (F.col("along_m") > F.col("across_m")))
    boxes = boxes.withColumn("shape", F.when(chain, "cadena").when(F.col("across_m") > F.col("along_m"), "paralelas").otherwise("mixta")).drop("_mean")
    own = placed.join(boxes.select(key, "rows", "shape"), key)
    own = ranked(own, key, F.floor(F.col("along") / METRES), "along", order, name="_place")
    line = F.col("shape") == "cadena"
    places = own.withColumns({"pos": F.when(line, F.col("_place")).otherwise(1), "pos_total": F.when(line, F.col("rows").cast("int")).otherwise(1)})
    return places.where("shape <> 'mixta'").select("row_id", "pos", "pos_total"), boxes
