"""Tracker rows resolved once: ends, pitch, origin end, inversion, string numbers, bounds and what is odd about them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import norm, to_local
from ..functions.layout import Layout

# The sides of a road and what lies opposite.
OPPOSITE = {"north": "south", "south": "north", "east": "west", "west": "east"}
#: Columns that rows may have besides their ends; null where they are not given.
OPTIONAL = {
    "side": "string", "pos": "double", "pos_total": "double", "origin_flag": "string", "string_inverted": "array<boolean>",
    "string_numbers": "array<double>", "string_labels": "array<string>", "pitch_mm": "double",
}


@dataclass(frozen=True)
class Farm:
    """How a farm counts: layout, origin of the local plane, matching limits (metres), and rules. Numbers and names may be columns, where
    one table holds rows of many farms: see `operators.farms`.

    origin: fixed-end (towards `fixed_end`), dc-box-end (at the road, or at the outer edge) or per-row-flag. inversion: none,
    piercing-chain or per-string-flag. offset_mode: whether the layout's offset holds at both ends, at the origin or nowhere.
    pitch: None for width and gap, `derive` from each row's length, or metres. tolerance: millimetres a module.
    """

    lat: float
    lon: float
    layout: Layout = field(default_factory=Layout)
    max_distance: float = 30.0
    neighbourhood: int = 2
    rows: int = 3
    accuracy: float = 3.0
    cell: float | None = None
    origin: str = "dc-box-end"
    fixed_end: str | None = None
    dc_box: str = "center-road"
    inversion: str = "piercing-chain"
    offset_mode: str = "both"
    pitch: float | str | None = None
    tolerance: float = 15.0

    #: Columns that tell farms apart, beside the ids of fixes and rows.
    by: ClassVar[tuple[str, ...]] = ()

    def attached(self, df: DataFrame, *fields: str) -> DataFrame:
        """`df` with the columns that these fields of the farm need: none for a single farm."""
        return df

    @property
    def stated_pitch(self) -> tuple[Column, Column]:
        """(mode, metres): nominal, derive or explicit, and the pitch if explicit."""
        mode = "nominal" if self.pitch is None else "derive" if self.pitch == "derive" else "explicit"
        return F.lit(mode), F.lit(float(self.pitch) if mode == "explicit" else None).cast("double")

    @property
    def cell_size(self) -> float | Column:
        """Metres of a cell's side: `cell`, or the power of two that holds a circle of `max_distance`, 64 at least."""
        return self.cell or 2.0 ** max(6, math.ceil(math.log2(2 * max(self.max_distance, 1))))

    @property
    def most_rows(self) -> int:
        """No fix is held against more of its nearest rows than this."""
        return max(1, self.rows)


def fix_key(df: DataFrame) -> list[str]:
    """What tells fixes apart: their id, and the farm where there is one."""
    return [c for c in ("farm_id", "fix_id") if c in df.columns]


def opposite_end(end: Column) -> Column:
    return F.when(end == "start", "end").when(end == "end", "start")


def end_towards(direction: Column) -> Column:
    """Which end of a row (ax, ay, bx, by) points to a direction; of two equally far ones the end counts as north and east."""
    start_north, start_east = F.col("ay") > F.col("by"), F.col("ax") > F.col("bx")
    start = F.when(direction == "north", start_north).when(direction == "south", ~start_north).when(direction == "east", start_east).when(direction == "west", ~start_east)
    return F.when(start, "start").when(~start, "end")


def origin_end(farm: Farm) -> tuple[Column, Column]:
    """The end where a row's count begins, and the warning of the rule that lacks its datum (the start is taken then)."""
    rule, side = F.lit(farm.origin), F.col("side")
    across = F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair])[side]
    box = end_towards(F.when(F.lit(farm.dc_box) == "center-road", across).otherwise(side))
    found = F.when(rule == "fixed-end", end_towards(F.lit(farm.fixed_end))).when(rule == "per-row-flag", F.nullif("origin_flag", F.lit(""))).otherwise(box)
    return F.coalesce(found, F.lit("start")), F.when(found.isNull(), F.when(rule.isin("fixed-end", "per-row-flag"), "missing-flag").otherwise("missing-side"))


def inversions(farm: Farm) -> tuple[Column, Column]:
    """For each string of a row whether it is counted from its far end, and a warning for each that lacks its datum."""
    rule, strings = F.lit(farm.inversion), F.lit(farm.layout.strings)
    known = lambda c: F.when(rule == "none", False).when(rule == "per-string-flag", F.get("string_inverted", c)).when(c == 0, False).otherwise(F.col("pos") < F.col("pos_total"))
    flags = F.transform(F.sequence(F.lit(0), strings - 1), known)
    code = F.when(rule == "piercing-chain", "missing-chain-position").otherwise("missing-flag")
    return F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), F.transform(F.filter(flags, lambda x: x.isNull()), lambda _: code)


def string_names(strings: int | Column) -> tuple[Column, Column, Column]:
    """Numbers of a row's strings from the origin on, their labels (null without any), and whether there are too few or too many.

    Given numbers are sorted with their labels, cut to `strings`, or go on by one; without any they are 1, 2 and so on.
    """
    n = F.size(F.coalesce("string_numbers", F.array().cast("array<double>")))
    pairs = F.transform("string_numbers", lambda x, i: F.struct(x.alias("n"), i.alias("i"), F.coalesce(F.get("string_labels", i), F.lit("")).alias("label")))
    pairs = F.array_sort(pairs)
    given = F.transform(pairs, lambda p: p["n"])
    more = F.when(n < strings, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(strings) - n, F.lit(1))), lambda k: F.element_at(given, -1) + k)).otherwise(F.array().cast("array<double>"))
    numbers = F.when(n > 0, F.slice(F.concat(given, more), 1, strings)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(strings)), lambda k: k.cast("double")))
    labels = F.when((n > 0) & (F.size(F.coalesce("string_labels", F.array().cast("array<string>"))) > 0), F.transform(pairs, lambda p: p["label"]))
    return numbers, labels, (n > 0) & (n != strings)


def compile_rows(rows: DataFrame, farm: Farm, strict: bool = True) -> DataFrame:
    """Adds to each row (row_id, lat_a, lon_a, lat_b, lon_b and those in OPTIONAL) all that locating needs, and warnings.

    Rows of zero length and rows whose offsets leave no room have a `reason`; `strict` raises on the first of them, else they stay
    and are found by it. strategy_warnings: codes of rules without their datum. build_warnings: missing-flag for a wrong count of
    string numbers, length-mismatch where the length asks for another pitch. An empty table gives no rows; see `require_rows`.
    """
    layout = farm.layout
    rows = farm.attached(rows)
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in rows.columns})
    lat0, lon0 = F.lit(farm.lat), F.lit(farm.lon)
    ax, ay = to_local(F.col("lat_a"), F.col("lon_a"), lat0, lon0)
    bx, by = to_local(F.col("lat_b"), F.col("lon_b"), lat0, lon0)
    out = rows.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}).withColumn("length", norm(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    mode, offset = F.lit(farm.offset_mode), F.lit(layout.offset)
    near, far = F.when(mode == "none", 0.0).otherwise(offset), F.when(mode == "both", offset).otherwise(0.0)
    room = F.col("length") - near - far
    reason = F.when(F.col("length") == 0, "zero-length").when(room <= 0, "no-room")
    out = out.withColumn("reason", reason)
    if strict:
        out = out.withColumn("length", F.when(F.col("reason").isNull(), F.col("length")).otherwise(F.raise_error(F.concat("reason", F.lit(": "), "row_id")).cast("double")))
    length = F.nullif(F.col("length"), F.lit(0.0))
    derived = (room - (layout.strings - 1) * layout.string_gap + layout.strings * layout.gap) / layout.total
    pitch_mode, pitch = farm.stated_pitch
    stated = F.when(pitch_mode == "derive", derived).when(pitch_mode == "explicit", pitch).otherwise(F.lit(layout.pitch))
    origin, origin_warning = origin_end(farm)
    inverted, inversion_warnings = inversions(farm)
    numbers, labels, odd_count = string_names(layout.strings)
    pad = farm.max_distance
    out = out.withColumns({"pitch": F.coalesce(F.col("pitch_mm") / 1000, stated), "derived_pitch": derived})
    residual = (F.col("derived_pitch") - F.col("pitch")) * 1000
    own = layout.of_rows(F.col("pitch"), near)
    codes = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return out.withColumns(
        {
            "ux": (F.col("bx") - F.col("ax")) / length,
            "uy": (F.col("by") - F.col("ay")) / length,
            "origin_offset": near,
            "far_offset": far,
            "predicted_length": near + own.extent + far,
            "residual_mm": residual,
            "origin_end": origin,
            "inverted": inverted,
            "numbers": numbers,
            "labels": labels,
            "strategy_warnings": F.concat(codes(origin_warning), inversion_warnings),
            "build_warnings": codes(F.when(F.abs(residual) > farm.tolerance, "length-mismatch"), F.when(odd_count, "missing-flag")),
            "min_x": F.least("ax", "bx") - pad,
            "max_x": F.greatest("ax", "bx") + pad,
            "min_y": F.least("ay", "by") - pad,
            "max_y": F.greatest("ay", "by") + pad,
        }
    )


def require_rows(rows: DataFrame) -> DataFrame:
    """Raises if there are no rows: a farm without rows cannot be compiled."""
    if not rows.limit(1).count():
        raise ValueError("a farm needs at least one row")
    return rows


def repeated_ids(rows: DataFrame) -> DataFrame:
    """One row (row_id, row_ord, code missing-flag, and farm_id where there is one) for every occurrence of an id after its first, by row_ord."""
    key = [c for c in ("farm_id", "row_id") if c in rows.columns]
    firsts = rows.groupBy(key).agg(F.min("row_ord").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(firsts, key).where("row_ord > _first").select(*key, "row_ord", F.lit("missing-flag").alias("code"))


def row_warnings(compiled: DataFrame) -> DataFrame:
    """The warnings of each row that has any: row_id, codes (first those of building, then of rules), grouped over repeated ids."""
    return compiled.groupBy([c for c in ("farm_id", "row_id") if c in compiled.columns]).agg(F.flatten(F.collect_list(F.concat("build_warnings", "strategy_warnings"))).alias("codes")).where("size(codes) > 0")


def lat_lon_bounds(rows: DataFrame) -> DataFrame:
    """One row: the least and greatest latitude and longitude over both ends; nulls without rows."""
    return rows.agg(
        F.min(F.least("lat_a", "lat_b")).alias("min_lat"), F.max(F.greatest("lat_a", "lat_b")).alias("max_lat"),
        F.min(F.least("lon_a", "lon_b")).alias("min_lon"), F.max(F.greatest("lon_a", "lon_b")).alias("max_lon"),
    )


def local_bounds(compiled: DataFrame) -> DataFrame:
    """One row: bounds over both ends on the farm's plane, and their width and height in kilometres."""
    out = compiled.agg(F.min(F.least("ax", "bx")).alias("min_x"), F.max(F.greatest("ax", "bx")).alias("max_x"), F.min(F.least("ay", "by")).alias("min_y"), F.max(F.greatest("ay", "by")).alias("max_y"))
    return out.withColumns({"width_km": (F.col("max_x") - F.col("min_x")) / 1000, "height_km": (F.col("max_y") - F.col("min_y")) / 1000})


def centroid(rows: DataFrame) -> DataFrame:
    """One row: the mean of all ends, each counted once."""
    return rows.agg(F.avg((F.col("lat_a") + F.col("lat_b")) / 2).alias("lat"), F.avg((F.col("lon_a") + F.col("lon_b")) / 2).alias("lon"))


def map_links(rows: DataFrame) -> DataFrame:
    """Adds `link` to an online map at the middle of each row."""
    lat, lon = (F.col("lat_a") + F.col("lat_b")) / 2, (F.col("lon_a") + F.col("lon_b")) / 2
    return rows.withColumn("link", F.format_string("https://www.google.com/maps?q=%.6f,%.6f", lat, lon))
