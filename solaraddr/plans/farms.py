"""Registered queries on a second farm, whose rows are slanted and carry flags, string numbers and pitches of their own, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.geo import distance_m, point_along
from ..functions.layout import Layout
from ..operators import compiled as C
from ..operators import locate as L
from .driver import A, E2, e7, mm, query, read

SLANTED = C.Farm(-27.4, 152.7, Layout(14, 2, 2.0, 0.02, 1.0, 0.0), 20.0, 1, 3, 1.0, origin="per-row-flag", inversion="per-string-flag", offset_mode="none", pitch="derive")


def slanted_rows(spark, sf_dir):
    k = F.col("p_partkey")
    lat, lon = F.lit(-27.4) + (k % 40) * F.lit(0.0009), F.lit(152.7) + F.floor(k / 40) * F.lit(0.0004)
    doubles = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    return read(spark, sf_dir, "part").select(
        k.alias("row_ord"),
        F.concat(F.lit("s"), k.cast("string")).alias("row_id"),
        F.floor(k / 40).cast("string").alias("block"),
        (k % 40).cast("string").alias("tracker"),
        F.when(k % 2 == 0, "R1").alias("tracker_row"),
        lat.alias("lat_a"),
        lon.alias("lon_a"),
        (lat - 0.0005).alias("lat_b"),
        F.when(k % 2 == 0, lon + 0.0003).otherwise(lon - 0.0003).alias("lon_b"),
        F.when(k % 4 == 0, "north").when(k % 4 == 1, "south").when(k % 4 == 2, "east").alias("side"),
        F.when(k % 7 > 0, (k % 5).cast("double")).alias("pos"),
        F.lit(4.0).alias("pos_total"),
        F.when(k % 3 == 0, "start").when(k % 3 == 1, "end").alias("origin_flag"),
        F.when(k % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True))).alias("string_inverted"),
        F.when(k % 4 == 1, doubles(6, 5)).when(k % 4 == 2, doubles(3)).when(k % 4 == 3, doubles(9, 7, 8)).alias("string_numbers"),
        F.when(k % 4 == 1, F.array(F.lit("S6"), F.lit("S5"))).alias("string_labels"),
        F.when(k % 11 == 0, F.lit(2150.0)).alias("pitch_mm"),
    )


def slanted_fixes(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("fix_id"),
        (F.lit(-27.4) + (e * 7919 % 36000) * F.lit(0.000001)).alias("lat"),
        (F.lit(152.7) + (e * 104729 % 20003) * F.lit(0.000001)).alias("lon"),
        F.when(e % 3 == 0, 2.5).when(e % 3 == 1, 0.0).alias("accuracy"),
    )


def near(spark, sf_dir):
    return L.near_rows(slanted_fixes(spark, sf_dir), slanted_rows(spark, sf_dir), SLANTED)


def located(spark, sf_dir):
    return L.candidates(near(spark, sf_dir), SLANTED)


D = "CAST({} AS DOUBLE)".format
ROWS = f"""
WITH given AS (SELECT p_partkey AS k, 's' || p_partkey AS row_id, {D(-27.4)} + (p_partkey % 40) * {D(0.0009)} AS lat_a, {D(152.7)} + (p_partkey // 40) * {D(0.0004)} AS lon_a,
    CASE p_partkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' END AS side, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 5 END AS pos,
    CASE p_partkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' END AS flag, CASE p_partkey % 4 WHEN 1 THEN [5, 6] WHEN 2 THEN [3, 4] WHEN 3 THEN [7, 8] ELSE [1, 2] END AS numbers,
    CASE WHEN p_partkey % 4 = 1 THEN ['S5', 'S6'] END AS labels FROM part),
scale AS (SELECT {A} / sqrt(w) * cos(radians({D(-27.4)})) AS east, {A * (1 - E2)} / (w * sqrt(w)) AS north_m
  FROM (SELECT 1 - {E2} * sin(radians({D(-27.4)})) * sin(radians({D(-27.4)})) AS w)),
ends AS (SELECT *, lat_a - {D(0.0005)} AS lat_b, CASE WHEN k % 2 = 0 THEN lon_a + {D(0.0003)} ELSE lon_a - {D(0.0003)} END AS lon_b FROM given),
flat AS (SELECT e.*, radians(lon_a - {D(152.7)}) * east AS ax, radians(lat_a + {D(27.4)}) * north_m AS ay, radians(lon_b - {D(152.7)}) * east AS bx, radians(lat_b + {D(27.4)}) * north_m AS byy FROM ends e, scale),
rows AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)) AS length FROM flat)
"""
LOCATED = ROWS + f""",
pitched AS (SELECT *, CASE WHEN k % 11 = 0 THEN {D(2.15)} ELSE (length - 1 + 2 * {D(0.02)}) / 28 END AS pitch, (length - 1 + 2 * {D(0.02)}) / 28 AS derived, (bx - ax) / length AS ux, (byy - ay) / length AS uy, coalesce(flag, 'start') AS origin_end FROM rows),
compiled AS (SELECT *, 14 * pitch - {D(0.02)} AS span, 14 * pitch - {D(0.02)} + 1 AS period,
    concat_ws(',', CASE WHEN flag IS NULL THEN 'missing-flag' END, CASE WHEN k % 2 = 1 THEN 'missing-flag' END) AS rules FROM pitched),
points AS (SELECT event_id AS fix_id, {D(-27.4)} + (event_id * 7919 % 36000) * {D(0.000001)} AS lat, {D(152.7)} + (event_id * 104729 % 20003) * {D(0.000001)} AS lon, CASE event_id % 3 WHEN 0 THEN {D(2.5)} ELSE {D(1)} END AS sigma FROM events),
fixes AS (SELECT p.*, radians(lon - {D(152.7)}) * east AS x, radians(lat + {D(27.4)}) * north_m AS y FROM points p, scale),
pairs AS (SELECT f.*, c.*, (x - ax) * ux + (y - ay) * uy AS along FROM fixes f JOIN compiled c ON x BETWEEN least(ax, bx) - 20 AND greatest(ax, bx) + 20 AND y BETWEEN least(ay, byy) - 20 AND greatest(ay, byy) + 20),
measured AS (SELECT *, sqrt(power(x - ax - ux * least(greatest(along, 0), length), 2) + power(y - ay - uy * least(greatest(along, 0), length), 2)) AS distance FROM pairs),
near AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY distance, k) AS row_rank FROM measured WHERE distance <= 20 QUALIFY row_rank <= 3),
hits AS (SELECT *, CASE WHEN origin_end = 'start' THEN along ELSE length - along END AS d, max(CASE WHEN row_rank = 1 THEN pitch END) OVER (PARTITION BY fix_id) AS winner_pitch FROM near),
strings AS (SELECT *, least(greatest(floor(d / period), 0), 1) AS s FROM hits),
placed AS (SELECT *, CAST(least(greatest(s * 14 + floor((d - s * period) / pitch) + 1, 1), 28) AS INT) AS centre, d - s * period > span AND s < 1 AS in_gap, s * 14 + (d - s * period) / pitch + 1 AS raw,
    CAST(least(12, greatest(1, ceil(2 * sigma / winner_pitch))) AS INT) AS reach FROM strings),
spread AS (SELECT *, unnest(generate_series(greatest(1, centre - reach), least(28, centre + reach))) AS position FROM placed),
modules AS (SELECT *, (position - 1) // 14 AS chunk, ((position - 1) // 14) * period + ((position - 1) % 14) * pitch + 1 AS mid FROM spread),
turned AS (SELECT *, CASE WHEN k % 2 = 0 THEN chunk = 1 ELSE chunk = 0 END AS inverted, CASE WHEN origin_end = 'start' THEN mid ELSE length - mid END AS along_start FROM modules),
centred AS (SELECT *, sqrt(power(x - ax - ux * along_start, 2) + power(y - ay - uy * along_start, 2)) AS module_distance, CAST(CASE WHEN inverted THEN 14 - (position - 1) % 14 ELSE (position - 1) % 14 + 1 END AS INT) AS module,
    CAST(numbers[chunk + 1] AS DOUBLE) AS string_number, labels[chunk + 1] AS string_label FROM turned),
weighed AS (SELECT *, exp(-0.5 * power(module_distance / sigma, 2)) AS weight FROM centred),
found AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY fix_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY fix_id) ELSE 0 END AS confidence,
    row_number() OVER (PARTITION BY fix_id ORDER BY module_distance, row_rank, position) AS rank FROM weighed)
"""


@query(
    ROWS + """SELECT row_id, 'fixed-end' AS rule, CASE WHEN ax > bx THEN 'start' ELSE 'end' END AS origin_end, 'start' AS opposite, '' AS codes, ax > bx AS at_start FROM rows WHERE false
    UNION ALL SELECT row_id, 'fixed-end', CASE WHEN ax > bx THEN 'start' ELSE 'end' END, CASE WHEN ax > bx THEN 'end' ELSE 'start' END, '', ax > bx FROM rows
    UNION ALL SELECT row_id, 'outer-edge', e, CASE e WHEN 'start' THEN 'end' ELSE 'start' END, CASE WHEN side IS NULL THEN 'missing-side' ELSE '' END, e = 'start'
      FROM (SELECT *, CASE side WHEN 'north' THEN CASE WHEN ay > byy THEN 'start' ELSE 'end' END WHEN 'south' THEN CASE WHEN ay > byy THEN 'end' ELSE 'start' END WHEN 'east' THEN CASE WHEN ax > bx THEN 'start' ELSE 'end' END ELSE 'start' END AS e FROM rows)
    UNION ALL SELECT row_id, 'center-road', e, CASE e WHEN 'start' THEN 'end' ELSE 'start' END, CASE WHEN side IS NULL THEN 'missing-side' ELSE '' END, e = 'start'
      FROM (SELECT *, CASE side WHEN 'south' THEN CASE WHEN ay > byy THEN 'start' ELSE 'end' END WHEN 'north' THEN CASE WHEN ay > byy THEN 'end' ELSE 'start' END WHEN 'east' THEN CASE WHEN ax > bx THEN 'end' ELSE 'start' END ELSE 'start' END AS e FROM rows)
    UNION ALL SELECT row_id, 'per-row-flag', coalesce(flag, 'start'), CASE flag WHEN 'end' THEN 'start' ELSE 'end' END, CASE WHEN flag IS NULL THEN 'missing-flag' ELSE '' END, coalesce(flag, 'start') = 'start' FROM rows
    UNION ALL SELECT row_id, 'unknown', 'start', 'end', 'missing-flag', true FROM rows""",
    base=False,
)
def origin_strategy(spark, sf_dir):
    """The origin end under each rule: the road or the outer edge for DC boxes, a fixed end, a flag, and a fixed end that is not stated."""
    rows, plain = slanted_rows(spark, sf_dir), replace(SLANTED, inversion="none")
    farms = {
        "fixed-end": replace(plain, origin="fixed-end", fixed_end="east"),
        "outer-edge": replace(plain, origin="dc-box-end", dc_box="outer-edge"),
        "center-road": replace(plain, origin="dc-box-end"),
        "per-row-flag": plain,
        "unknown": replace(plain, origin="fixed-end"),
    }
    out = None
    for rule, farm in farms.items():
        end = F.col("origin_end")
        one = C.compile_rows(rows, farm).select("row_id", F.lit(rule).alias("rule"), "origin_end", C.opposite_end(end).alias("opposite"), F.array_join("strategy_warnings", ",").alias("codes"), (end == "start").alias("at_start"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    ROWS + """SELECT row_id, 'none' AS rule, 'false,false' AS flags, '' AS codes FROM rows
    UNION ALL SELECT row_id, 'piercing-chain', CASE WHEN pos < 4 THEN 'false,true' ELSE 'false,false' END, CASE WHEN pos IS NULL THEN 'missing-chain-position' ELSE '' END FROM rows
    UNION ALL SELECT row_id, 'per-string-flag', CASE WHEN k % 2 = 0 THEN 'false,true' ELSE 'true,false' END, CASE WHEN k % 2 = 1 THEN 'missing-flag' ELSE '' END FROM rows""",
    base=False,
)
def inversion_strategy(spark, sf_dir):
    rows, out = slanted_rows(spark, sf_dir), None
    for rule in ("none", "piercing-chain", "per-string-flag"):
        farm = replace(SLANTED, origin="fixed-end", fixed_end="north", inversion=rule)
        one = C.compile_rows(rows, farm).select("row_id", F.lit(rule).alias("rule"), F.array_join(F.col("inverted").cast("array<string>"), ",").alias("flags"), F.array_join("strategy_warnings", ",").alias("codes"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    ROWS + f""", modes AS (SELECT unnest([{{'mode': 'both', 'near': {D(-0.5)}, 'far': {D(-0.5)}}}, {{'mode': 'origin', 'near': {D(-0.5)}, 'far': {D(0)}}}, {{'mode': 'none', 'near': {D(0)}, 'far': {D(0)}}}]) AS m),
    pitched AS (SELECT *, (length - m.near - m.far - 1 + 2 * {D(0.02)}) / 28 AS derived FROM rows, modes),
    used AS (SELECT *, CASE WHEN k % 11 = 0 THEN {D(2.15)} ELSE derived END AS pitch FROM pitched)
    SELECT row_id, m.mode AS mode, CAST(round(pitch * 1e6) AS BIGINT) AS pitch_um, CAST(round((derived - pitch) * 1e6) AS BIGINT) AS residual_um,
    CAST(round((m.near + m.far + 2 * (14 * pitch - {D(0.02)}) + 1) * 1000) AS BIGINT) AS predicted_mm, CAST(round(length * 1000) AS BIGINT) AS length_mm FROM used""",
    base=False,
)
def derived_pitch(spark, sf_dir):
    """Pitch from each row's length under the three modes of the stake offset, and the length that it predicts; some rows state their own."""
    rows, out = slanted_rows(spark, sf_dir), None
    for mode in ("both", "origin", "none"):
        farm = replace(SLANTED, layout=replace(SLANTED.layout, offset=-0.5), offset_mode=mode)
        one = C.compile_rows(rows, farm).select(
            "row_id", F.lit(mode).alias("mode"), F.round(F.col("pitch") * 1e6).cast("long").alias("pitch_um"), F.round(F.col("residual_mm") * 1000).cast("long").alias("residual_um"), mm(F.col("predicted_length")).alias("predicted_mm"), mm(F.col("length")).alias("length_mm")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    ROWS + f"""SELECT row_id, 'nominal' AS pitch, abs((length - 1 + 2 * {D(0.02)}) / 28 - CASE WHEN k % 11 = 0 THEN {D(2.15)} ELSE {D(2.02)} END) > {D(0.075)} AS mismatch, k % 4 IN (2, 3) AS odd_count FROM rows
    UNION ALL SELECT row_id, 'explicit', abs((length - 1 + 2 * {D(0.02)}) / 28 - CASE WHEN k % 11 = 0 THEN {D(2.15)} ELSE {D(2.2)} END) > {D(0.015)}, k % 4 IN (2, 3) FROM rows""",
    base=False,
)
def length_mismatch(spark, sf_dir):
    """Rows whose length asks for a pitch over the tolerance away from the nominal one or an explicit one."""
    rows, out = slanted_rows(spark, sf_dir), None
    for name, pitch, tolerance in (("nominal", None, 75.0), ("explicit", 2.2, 15.0)):
        codes = lambda c: F.array_contains("build_warnings", c)
        one = C.compile_rows(rows, replace(SLANTED, pitch=pitch, tolerance=tolerance)).select("row_id", F.lit(name).alias("pitch"), codes("length-mismatch").alias("mismatch"), codes("missing-flag").alias("odd_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query(ROWS + "SELECT row_id, array_to_string(numbers, ',') AS numbers, array_to_string(labels, ',') AS labels FROM rows", base=False)
def string_number_normalise(spark, sf_dir):
    c = C.compile_rows(slanted_rows(spark, sf_dir), SLANTED)
    return c.select("row_id", F.array_join(F.transform("numbers", lambda x: x.cast("long").cast("string")), ",").alias("numbers"), F.array_join("labels", ",").alias("labels"))


@query(
    "SELECT p_partkey, CAST(round((2 * (14 * (1.5 + p_partkey % 10 / 10.0) - 0.02) + 1) * 1000) AS BIGINT) AS extent_mm FROM part", base=False
)
def module_extent(spark, sf_dir):
    layout = SLANTED.layout.of_rows(1.5 + F.col("p_partkey") % 10 / 10.0, F.lit(0.0))
    return read(spark, sf_dir, "part").select("p_partkey", mm(layout.extent).alias("extent_mm"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'zero-length' WHEN p_partkey % 3 = 1 THEN 'no-room' END AS reason FROM part", base=False)
def rejected_rows(spark, sf_dir):
    """Rows without length, and rows that offsets leave no room, found by their reason instead of stopping the job."""
    k = F.col("p_partkey")
    lat_b = F.lit(-27.4) - F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.000005).otherwise(0.0005)
    rows = read(spark, sf_dir, "part").select(k.alias("p_partkey"), k.alias("row_ord"), k.cast("string").alias("row_id"), F.lit(-27.4).alias("lat_a"), F.lit(152.7).alias("lon_a"), lat_b.alias("lat_b"), F.lit(152.7).alias("lon_b"))
    return C.compile_rows(rows, replace(SLANTED, layout=replace(SLANTED.layout, offset=1.0), offset_mode="both"), strict=False).select("p_partkey", "reason")


@query("SELECT o_orderkey AS row_ord, CAST(o_custkey AS VARCHAR) AS row_id, 'missing-flag' AS code FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1", base=False)
def repeated_row_ids(spark, sf_dir):
    return C.repeated_ids(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_ord"), F.col("o_custkey").cast("string").alias("row_id")))


@query(
    ROWS + f"""SELECT row_id, concat_ws(',', CASE WHEN k % 11 = 0 AND abs((length - 1 + 2 * {D(0.02)}) / 28 - {D(2.15)}) > {D(0.015)} THEN 'length-mismatch' END, CASE WHEN k % 4 IN (2, 3) THEN 'missing-flag' END,
    CASE WHEN flag IS NULL THEN 'missing-flag' END, CASE WHEN k % 2 = 1 THEN 'missing-flag' END) AS codes FROM rows WHERE codes <> ''""",
    base=False,
)
def warnings_of_rows(spark, sf_dir):
    return C.row_warnings(C.compile_rows(slanted_rows(spark, sf_dir), SLANTED)).select("row_id", F.array_join("codes", ",").alias("codes"))


@query(
    ROWS + "SELECT CAST(round(min(least(lat_a, lat_b)) * 1e7) AS BIGINT) AS min_lat, CAST(round(max(greatest(lat_a, lat_b)) * 1e7) AS BIGINT) AS max_lat, CAST(round(min(least(lon_a, lon_b)) * 1e7) AS BIGINT) AS min_lon, CAST(round(max(greatest(lon_a, lon_b)) * 1e7) AS BIGINT) AS max_lon FROM rows",
    base=False,
)
def geographic_bounds(spark, sf_dir):
    return C.lat_lon_bounds(slanted_rows(spark, sf_dir)).select(*[e7(F.col(c)).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query(
    ROWS + "SELECT CAST(round(min(least(ax, bx)) * 1000) AS BIGINT) AS min_x_mm, CAST(round(max(greatest(ay, byy)) * 1000) AS BIGINT) AS max_y_mm, CAST(round((max(greatest(ax, bx)) - min(least(ax, bx))) * 1000) AS BIGINT) AS width_mm, CAST(round((max(greatest(ay, byy)) - min(least(ay, byy))) * 1000) AS BIGINT) AS height_mm FROM rows",
    base=False,
)
def local_extent(spark, sf_dir):
    out = C.local_bounds(C.compile_rows(slanted_rows(spark, sf_dir), SLANTED))
    return out.select(mm(F.col("min_x")).alias("min_x_mm"), mm(F.col("max_y")).alias("max_y_mm"), F.round(F.col("width_km") * 1e6).cast("long").alias("width_mm"), F.round(F.col("height_km") * 1e6).cast("long").alias("height_mm"))


@query(ROWS + "SELECT row_id, format('https://www.google.com/maps?q={:.6f},{:.6f}', (lat_a + lat_b) / 2, (lon_a + lon_b) / 2) AS link FROM rows", base=False)
def map_links(spark, sf_dir):
    return C.map_links(slanted_rows(spark, sf_dir)).select("row_id", "link")


@query(
    ROWS + "SELECT a.row_id, CAST(round(sqrt(power(a.ax - b.ax, 2) + power(a.ay - b.ay, 2)) * 1000) AS BIGINT) AS apart_mm, CAST(round((a.ax + (a.bx - a.ax) * 10 / a.length) * 1000) AS BIGINT) AS x_mm, CAST(round((a.ay + (a.byy - a.ay) * 10 / a.length) * 1000) AS BIGINT) AS y_mm FROM rows a, rows b WHERE b.k = 0",
    base=False,
)
def plane_distance(spark, sf_dir):
    """Metres from the first row's start, and the place ten metres along each row."""
    rows = C.compile_rows(slanted_rows(spark, sf_dir), SLANTED)
    apart = distance_m(F.lit(-27.4), F.lit(152.7), F.col("lat_a"), F.col("lon_a"), F.lit(-27.4))
    x, y = point_along(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.lit(10.0))
    return rows.select("row_id", mm(apart).alias("apart_mm"), mm(x).alias("x_mm"), mm(y).alias("y_mm"))


@query(LOCATED + "SELECT fix_id, row_id, position, module, string_number, string_label, CASE WHEN inverted THEN 'far-end' ELSE 'near-dc' END AS counted_from, CAST(round(module_distance * 1000) AS BIGINT) AS distance_mm, CAST(round(confidence * 1000) AS BIGINT) AS confidence_pm FROM found WHERE rank = 1", base=False)
def locate_slanted(spark, sf_dir):
    best = located(spark, sf_dir).where("rank = 1")
    return best.select("fix_id", "row_id", "position", "module", "string_number", "string_label", "counted_from", mm(F.col("module_distance")).alias("distance_mm"), F.round(F.col("confidence") * 1000).cast("long").alias("confidence_pm"))


@query(
    LOCATED + """, tops AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER w AS top, max(CASE WHEN rank = 1 THEN row_id END) OVER w AS top_row, max(CASE WHEN rank = 1 THEN string_number END) OVER w AS top_string FROM found WINDOW w AS (PARTITION BY fix_id))
    SELECT fix_id, concat_ws(',', nullif(max(CASE WHEN row_rank = 1 THEN rules END), ''), CASE WHEN bool_or(row_rank = 1 AND in_gap) THEN 'in-string-gap' END, CASE WHEN bool_or(row_rank = 1 AND (raw < 1 OR raw > 28)) THEN 'outside-row-extent' END,
    CASE WHEN max(top) < 0.35 THEN 'low-confidence' END, CASE WHEN bool_or(rank > 1 AND confidence > 0.6 * top AND (row_id <> top_row OR string_number <> top_string)) THEN 'ambiguous' END) AS codes FROM tops GROUP BY fix_id""",
    base=False,
)
def slanted_warnings(spark, sf_dir):
    return L.warnings(located(spark, sf_dir))


@query(
    LOCATED + """SELECT fix_id, row_id, CAST(round(along / length * 1e6) AS BIGINT) AS t_ppm, CAST(round(d * 1000) AS BIGINT) AS along_mm, CAST(round(length * 1000) AS BIGINT) AS length_mm, CAST(round(pitch * 1e6) AS BIGINT) AS pitch_um, origin_end, 'per-row-flag' AS origin_strategy,
    CASE WHEN k % 2 = 0 THEN centre > 14 ELSE centre <= 14 END AS inverted, CAST(round((derived - pitch) * 1e6) AS BIGINT) AS residual_um FROM placed WHERE row_rank = 1""",
    base=False,
)
def locate_winner(spark, sf_dir):
    w = L.winners(near(spark, sf_dir), SLANTED)
    um = lambda c, s=1e6: F.round(F.col(c) * s).cast("long")
    return w.select("fix_id", "row_id", um("t").alias("t_ppm"), mm(F.col("along_from_origin")).alias("along_mm"), mm(F.col("segment_length")).alias("length_mm"), um("pitch").alias("pitch_um"), "origin_end", "origin_strategy", "inverted", um("residual_mm", 1000).alias("residual_um"))


@query(LOCATED + "SELECT fix_id, count(*) AS rows_considered FROM pairs GROUP BY fix_id", base=False)
def rows_considered(spark, sf_dir):
    return L.rows_considered(L.rows_in_range(slanted_fixes(spark, sf_dir), C.compile_rows(slanted_rows(spark, sf_dir), SLANTED), SLANTED))


@query(LOCATED + "SELECT fix_id, row_id, CAST(round(distance * 1000) AS BIGINT) AS distance_mm FROM measured WHERE distance <= 8 QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY distance, k) = 1", base=False)
def nearest_row_within(spark, sf_dir):
    out = L.nearest_row(slanted_fixes(spark, sf_dir), C.compile_rows(slanted_rows(spark, sf_dir), SLANTED), SLANTED, 8.0)
    return out.select("fix_id", "row_id", mm(F.col("distance")).alias("distance_mm"))


@query(LOCATED + ", tops AS (SELECT *, max(CASE WHEN rank = 1 THEN row_id END) OVER (PARTITION BY fix_id) AS top_row FROM found) SELECT fix_id, row_id, min(position) AS first, max(position) AS last FROM tops WHERE row_id = top_row GROUP BY fix_id, row_id", base=False)
def best_row_range(spark, sf_dir):
    return L.best_row_range(located(spark, sf_dir))


@query(
    LOCATED + """SELECT fix_id, 'Block ' || (k // 40) || ', tracker ' || (k % 40) || CASE WHEN k % 2 = 0 THEN ' R1' ELSE '' END || ', string ' || CAST(string_number AS BIGINT) || ', module ' || module || CASE WHEN inverted THEN ' (from the far end)' ELSE ' (from the DC box)' END AS address FROM found WHERE rank = 1""",
    base=False,
)
def address_texts(spark, sf_dir):
    best = located(spark, sf_dir).where("rank = 1").join(slanted_rows(spark, sf_dir).select("row_id", "block", "tracker", "tracker_row"), "row_id")
    return best.select("fix_id", L.address_text(F.col("block"), F.col("tracker"), F.col("tracker_row"), F.col("string_number"), F.col("module"), F.col("counted_from")).alias("address"))
