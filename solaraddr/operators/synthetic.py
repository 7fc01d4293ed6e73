"""The way back: from a layout to the length of a row, from an anchor to its ends, from a slot to its coordinate. They make data, not answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import to_geo, to_local
from .compiled import Farm


def _offsets(farm: Farm) -> tuple[Column, Column]:
    """Stake offsets at the end where slots are counted from, and at both ends together."""
    mode, offset = F.lit(farm.offset_mode), F.lit(farm.layout.offset)
    near = F.when(mode == "none", 0.0).otherwise(offset)
    return near, near + F.when(mode == "both", offset).otherwise(0.0)


def nominal_pitch(farm: Farm) -> Column:
    """The pitch that a profile states; that of width and gap where it is derived or nominal."""
    mode, metres = farm.stated_pitch
    return F.when(mode == "explicit", metres).otherwise(F.lit(farm.layout.width + farm.layout.gap))


def nominal_length(farm: Farm) -> Column:
    """Metres from stake to stake of a row that is built as the profile says."""
    layout = farm.layout.of_rows(nominal_pitch(farm), F.lit(0.0))
    return layout.extent + _offsets(farm)[1]


def row_ends(lat: Column, lon: Column, azimuth: Column, length: Column) -> tuple[Column, Column]:
    """(lat, lon) of the other end of a row that starts at a place and runs `length` metres at `azimuth` degrees from north."""
    turn = F.radians(azimuth)
    return to_geo(F.sin(turn) * length, F.cos(turn) * length, lat, lon)


def planted_rows(anchors: DataFrame, farm: Farm) -> DataFrame:
    """Adds lat_b and lon_b to rows with lat_a, lon_a, azimuth and perhaps length (else, or where null, the nominal one)."""
    anchors = farm.attached(anchors)
    length = nominal_length(farm)
    if "length" in anchors.columns:
        length = F.coalesce("length", length)
    lat, lon = row_ends(F.col("lat_a"), F.col("lon_a"), F.col("azimuth"), length)
    return anchors.withColumns({"lat_b": lat, "lon_b": lon}).drop(*[c for c in anchors.columns if c.startswith("farm_") and c not in farm.by])


def slot_place(slot: Column, farm: Farm, from_end: Column, aside: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle of a row's slot (from 1, of all its modules in order), counted from `start` or `end`.

    Pure geometry of the segment: it knows nothing of origins, inversions and boxes. `aside` metres to the left of the axis, seen
    from the start, stand for an error of the receiver. The plane is the row's own, around its start.
    """
    lat0, lon0 = F.col("lat_a"), F.col("lon_a")
    dx, dy = to_local(F.col("lat_b"), F.col("lon_b"), lat0, lon0)
    length = F.hypot(dx, dy)
    layout = farm.layout.of_rows(nominal_pitch(farm), _offsets(farm)[0])
    distance = layout.distance_at(slot)
    along = F.when(from_end == "end", length - distance).otherwise(distance)
    ux, uy = dx / length, dy / length
    return to_geo(ux * along - uy * aside, uy * along + ux * aside, lat0, lon0)


def slots(rows: DataFrame, farm: Farm, from_end: str = "start", aside: Column | None = None) -> DataFrame:
    """Each row's slots as fixes: the columns of `rows`, slot, lat and lon. `aside` may refer to them."""
    out = farm.attached(rows).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(farm.layout.total))))
    lat, lon = slot_place(F.col("slot"), farm, F.lit(from_end), F.lit(0.0) if aside is None else aside)
    return out.withColumns({"lat": lat, "lon": lon}).select(*rows.columns, "slot", "lat", "lon")
