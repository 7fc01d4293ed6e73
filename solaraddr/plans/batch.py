"""Registered queries on many farms at once, on generated rows, and on crowded fixes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..operators import compiled as C
from ..operators import locate as L
from ..operators.farms import Farms
from ..operators.grid import adaptive_rows_in_range
from ..operators.synthetic import planted_rows, slots
from .driver import A, E2, FARM, SQL_BASE, fixes, mm, query, read, tracker_rows
from .farms import LOCATED, SLANTED, located

D = "CAST({} AS DOUBLE)".format


def nation_farms(spark, sf_dir) -> Farms:
    """A farm for each nation, each counting in its own way."""
    k = F.col("n_nationkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    width, gap = F.lit(1.1) + (k % 4) * F.lit(0.1), F.lit(0.02) + (k % 2) * F.lit(0.005)
    return Farms.of(
        read(spark, sf_dir, "nation").select(
            F.concat(F.lit("n"), k.cast("string")).alias("farm_id"), (F.lit(-20.0) - k * F.lit(0.5)).alias("lat"), (F.lit(120.0) + k).alias("lon"), (k % 3 * 4 + 16).cast("int").alias("modules"),
            (k % 2 + 1).cast("int").alias("strings"), width.alias("width"), gap.alias("gap"), ((k % 3) * F.lit(1.0)).alias("string_gap"), ((k % 3) * F.lit(-0.5)).alias("offset"),
            ((k % 4) * F.lit(5.0) + 15).alias("max_distance"), (k % 3).cast("int").alias("neighbourhood"), (k % 3 + 1).cast("int").alias("rows"), ((k % 2) * F.lit(1.0) + 1).alias("accuracy"),
            F.lit(64.0).alias("cell_size"), pick(3, "fixed-end", "dc-box-end", "per-row-flag").alias("origin"), pick(4, "north", "south", "east", "west").alias("fixed_end"),
            pick(2, "center-road", "outer-edge").alias("dc_box"), pick(3, "none", "per-string-flag", "piercing-chain").alias("inversion"), pick(3, "both", "origin", "none").alias("offset_mode"),
            pick(5, "derive", "explicit", "nominal", "nominal", "nominal").alias("pitch_mode"), (width + gap + F.lit(0.003)).alias("pitch"), F.lit(15.0).alias("tolerance"),
        )
    )


def nation_rows(spark, sf_dir):
    p = F.col("p_partkey")
    k, j = p % 25, F.floor(p / 25)
    lat, lon = F.lit(-20.0) - k * F.lit(0.5) + (j % 20) * F.lit(0.0009), F.lit(120.0) + k + F.floor(j / 20) * F.lit(0.00012)
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), k.cast("string")).alias("farm_id"), p.alias("row_ord"), F.concat(F.lit("r"), j.cast("string")).alias("row_id"), lat.alias("lat_a"), lon.alias("lon_a"),
        (lat - F.lit(0.0005)).alias("lat_b"), (lon + (j % 3 - 1) * F.lit(0.0001)).alias("lon_b"), F.when(j % 3 == 0, "north").when(j % 3 == 1, "south").alias("side"),
        F.when(j % 7 > 0, (j % 4 + 1).cast("double")).alias("pos"), F.lit(4.0).alias("pos_total"), F.when(j % 3 == 0, "start").when(j % 3 == 1, "end").alias("origin_flag"),
        F.when(j % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True))).alias("string_inverted"),
        F.when(j % 4 == 1, F.array(j.cast("double") * 2, j.cast("double") * 2 + 1)).alias("string_numbers"),
    )


def nation_fixes(spark, sf_dir):
    e = F.col("event_id")
    k = e % 25
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("n"), k.cast("string")).alias("farm_id"), F.floor(e / 25).alias("fix_id"), (F.lit(-20.0) - k * F.lit(0.5) + (e * 7919 % 18000) * F.lit(0.000001)).alias("lat"),
        (F.lit(120.0000002) + k + (e * 104729 % 601) * F.lit(0.000001)).alias("lon"), F.when(e % 3 == 0, 2.5).when(e % 3 == 1, 0.0).alias("accuracy"),
    )


FOUND = f"""
WITH farms AS (SELECT n_nationkey AS k, {D(-20)} - n_nationkey * {D(0.5)} AS lat0, {D(120)} + n_nationkey AS lon0, n_nationkey % 3 * 4 + 16 AS modules, n_nationkey % 2 + 1 AS strings,
    {D(1.1)} + (n_nationkey % 4) * {D(0.1)} AS width, {D(0.02)} + (n_nationkey % 2) * {D(0.005)} AS gap, (n_nationkey % 3) * {D(1)} AS sgap, (n_nationkey % 3) * {D(-0.5)} AS offs,
    (n_nationkey % 4) * {D(5)} + 15 AS maxd, n_nationkey % 3 AS nbh, n_nationkey % 3 + 1 AS most, n_nationkey % 2 + {D(1)} AS acc, ['north', 'south', 'east', 'west'][n_nationkey % 4 + 1] AS fixed,
    1 - {E2} * power(sin(radians({D(-20)} - n_nationkey * {D(0.5)})), 2) AS w FROM nation),
scaled AS (SELECT *, {A} / sqrt(w) * cos(radians(lat0)) AS east, {A * (1 - E2)} / (w * sqrt(w)) AS north_m, CASE WHEN k % 3 = 2 THEN 0 ELSE offs END AS near_o, CASE WHEN k % 3 = 0 THEN offs ELSE 0 END AS far_o FROM farms),
given AS (SELECT p_partkey AS ord, p_partkey % 25 AS k, p_partkey // 25 AS j FROM part),
placed_rows AS (SELECT ord, j, f.*, lat0 + (j % 20) * {D(0.0009)} AS lat_a, lon0 + (j // 20) * {D(0.00012)} AS lon_a FROM given JOIN scaled f USING (k)),
ends AS (SELECT *, radians(lon_a - lon0) * east AS ax, radians(lat_a - lat0) * north_m AS ay, radians(lon_a + (j % 3 - 1) * {D(0.0001)} - lon0) * east AS bx, radians(lat_a - {D(0.0005)} - lat0) * north_m AS byy FROM placed_rows),
long AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)) AS length FROM ends),
pitched AS (SELECT *, (bx - ax) / length AS ux, (byy - ay) / length AS uy, CASE k % 5 WHEN 0 THEN (length - near_o - far_o - (strings - 1) * sgap + strings * gap) / (modules * strings) WHEN 1 THEN width + gap + {D(0.003)} ELSE width + gap END AS pitch,
    CASE WHEN ax > bx THEN 'start' ELSE 'end' END AS to_east, CASE WHEN ax > bx THEN 'end' ELSE 'start' END AS to_west FROM long),
compiled AS (SELECT *, modules * pitch - gap AS span, modules * pitch - gap + sgap AS period,
    CASE k % 3 WHEN 0 THEN CASE fixed WHEN 'north' THEN 'start' WHEN 'south' THEN 'end' WHEN 'east' THEN to_east ELSE to_west END
    WHEN 1 THEN CASE WHEN j % 3 = 2 THEN 'start' WHEN (j % 3 = 0) = (k % 2 = 1) THEN 'start' ELSE 'end' END ELSE CASE j % 3 WHEN 1 THEN 'end' ELSE 'start' END END AS oend FROM pitched),
points AS (SELECT event_id // 25 AS fix_id, event_id % 25 AS k, {D(-20)} - (event_id % 25) * {D(0.5)} + (event_id * 7919 % 18000) * {D(0.000001)} AS lat, {D(120.0000002)} + event_id % 25 + (event_id * 104729 % 601) * {D(0.000001)} AS lon,
    CASE event_id % 3 WHEN 0 THEN {D(2.5)} END AS given_acc FROM events),
spots AS (SELECT fix_id, p.k, radians(lon - lon0) * east AS x, radians(lat - lat0) * north_m AS y, coalesce(given_acc, acc) AS sigma FROM points p JOIN scaled USING (k)),
pairs AS (SELECT s.fix_id, s.x, s.y, s.sigma, c.*, (x - ax) * ux + (y - ay) * uy AS along FROM spots s JOIN compiled c ON c.k = s.k AND x BETWEEN least(ax, bx) - maxd AND greatest(ax, bx) + maxd AND y BETWEEN least(ay, byy) - maxd AND greatest(ay, byy) + maxd),
meas AS (SELECT *, sqrt(power(x - ax - ux * least(greatest(along, 0), length), 2) + power(y - ay - uy * least(greatest(along, 0), length), 2)) AS distance FROM pairs),
near AS (SELECT *, row_number() OVER (PARTITION BY k, fix_id ORDER BY distance, ord) AS row_rank FROM meas WHERE distance <= maxd QUALIFY row_rank <= most),
hits AS (SELECT *, CASE WHEN oend = 'start' THEN along ELSE length - along END - near_o AS d, max(CASE WHEN row_rank = 1 THEN pitch END) OVER (PARTITION BY k, fix_id) AS winner_pitch FROM near),
chunks AS (SELECT *, least(greatest(floor(d / period), 0), strings - 1) AS s FROM hits),
centres AS (SELECT *, CAST(least(greatest(s * modules + floor((d - s * period) / pitch) + 1, 1), modules * strings) AS INT) AS centre, CAST(least(12, greatest(nbh, ceil(2 * sigma / winner_pitch))) AS INT) AS reach FROM chunks),
spread AS (SELECT *, unnest(generate_series(greatest(1, centre - reach), least(modules * strings, centre + reach))) AS position FROM centres),
mids AS (SELECT *, (position - 1) // modules AS chunk, near_o + ((position - 1) // modules) * period + ((position - 1) % modules) * pitch + width / 2 AS mid FROM spread),
turned AS (SELECT *, CASE WHEN oend = 'start' THEN mid ELSE length - mid END AS at_m, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN CASE WHEN j % 2 = 0 THEN chunk = 1 ELSE chunk = 0 END ELSE chunk > 0 AND j % 7 > 0 AND j % 4 + 1 < 4 END AS inverted FROM mids),
modules_of AS (SELECT *, sqrt(power(x - ax - ux * at_m, 2) + power(y - ay - uy * at_m, 2)) AS module_distance, CAST(CASE WHEN inverted THEN modules - (position - 1) % modules ELSE (position - 1) % modules + 1 END AS INT) AS module,
    CASE WHEN j % 4 = 1 THEN j * 2 + chunk ELSE chunk + 1 END AS string_number FROM turned),
weighed AS (SELECT *, exp(-0.5 * power(module_distance / sigma, 2)) AS weight FROM modules_of),
found AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY k, fix_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY k, fix_id) ELSE 0 END AS confidence,
    row_number() OVER (PARTITION BY k, fix_id ORDER BY module_distance, row_rank, position) AS rank FROM weighed)
"""


@query(
    FOUND + """SELECT 'n' || k AS farm_id, fix_id, 'r' || j AS row_id, position, module, CAST(string_number AS DOUBLE) AS string_number, CASE WHEN inverted THEN 'far-end' ELSE 'near-dc' END AS counted_from,
    CAST(rank AS INT) AS rank, CAST(round(module_distance * 1000) AS BIGINT) AS distance_mm, CAST(round(confidence * 1000) AS BIGINT) AS confidence_pm FROM found""",
    base=False,
)
def locate_many_farms(spark, sf_dir):
    """All candidates of fixes on as many farms as there are nations, each with a layout, rules, limits and a plane of its own, in one plan."""
    found = L.locate(nation_fixes(spark, sf_dir), nation_rows(spark, sf_dir), nation_farms(spark, sf_dir))
    return found.select(
        "farm_id", "fix_id", "row_id", F.col("position").cast("long").alias("position"), "module", "string_number", "counted_from", "rank", mm(F.col("module_distance")).alias("distance_mm"),
        F.round(F.col("confidence") * 1000).cast("long").alias("confidence_pm"),
    )


@query(
    LOCATED + """, best AS (SELECT fix_id, row_id, string_number, confidence, module_distance, sigma FROM found WHERE rank = 1),
    won AS (SELECT DISTINCT fix_id, row_id, in_gap, raw, rules FROM found WHERE row_rank = 1),
    range_of AS (SELECT f.fix_id, min(position) AS low, max(position) AS high FROM found f JOIN best b ON b.fix_id = f.fix_id AND b.row_id = f.row_id GROUP BY f.fix_id),
    rivals AS (SELECT f.fix_id, f.row_id, f.string_number, f.module_distance FROM found f JOIN best b USING (fix_id) WHERE f.rank > 1 AND f.confidence > 0.6 * b.confidence AND (f.row_id <> b.row_id OR f.string_number <> b.string_number)
      QUALIFY row_number() OVER (PARTITION BY f.fix_id ORDER BY f.rank) = 1),
    listed AS (SELECT fix_id, i AS place, 'missing-flag' AS code, row_id, NULL AS raw_mille, NULL AS low, NULL AS high, NULL AS string_number, NULL AS distance_mm, NULL AS best_mm
        FROM (SELECT *, unnest(generate_series(1, CASE WHEN rules = '' THEN 0 ELSE len(string_split(rules, ',')) END)) AS i FROM won)
      UNION ALL SELECT fix_id, 10, 'in-string-gap', row_id, NULL, NULL, NULL, NULL, NULL, NULL FROM won WHERE in_gap
      UNION ALL SELECT fix_id, 11, 'outside-row-extent', row_id, CAST(round(raw * 1000) AS BIGINT), NULL, NULL, NULL, NULL, NULL FROM won WHERE raw < 1 OR raw > 28
      UNION ALL SELECT fix_id, 12, 'low-confidence', NULL, NULL, low, high, NULL, NULL, NULL FROM best JOIN range_of USING (fix_id) WHERE confidence < 0.35
      UNION ALL SELECT r.fix_id, 13, 'ambiguous', r.row_id, NULL, NULL, NULL, r.string_number, CAST(round(r.module_distance * 1000) AS BIGINT), CAST(round(b.module_distance * 1000) AS BIGINT) FROM rivals r JOIN best b USING (fix_id))
    SELECT fix_id, CAST(row_number() OVER (PARTITION BY fix_id ORDER BY place) AS INT) AS place, code, row_id, raw_mille, low, high, string_number, distance_mm, best_mm FROM listed""",
    base=False,
)
def warning_details(spark, sf_dir):
    """The warnings of each fix as records, in their order, with the row, range or rival that each is about."""
    records = L.warning_records(located(spark, sf_dir), SLANTED).select("fix_id", F.posexplode("warnings").alias("i", "w"))
    return records.select(
        "fix_id", (F.col("i") + 1).alias("place"), "w.code", "w.row_id", F.round(F.col("w.raw") * 1000).cast("long").alias("raw_mille"), F.col("w.low").cast("long").alias("low"), F.col("w.high").cast("long").alias("high"),
        "w.string_number", mm(F.col("w.distance")).alias("distance_mm"), mm(F.col("w.best_distance")).alias("best_mm"),
    )


PLANTED = C.Farm(-27.4, 152.7, Layout(), accuracy=0.3, origin="fixed-end", fixed_end="north", inversion="piercing-chain")


def planted(spark, sf_dir):
    """Rows from anchors on one parallel, 148 m apart, each at its own azimuth."""
    k = F.col("p_partkey")
    anchors = read(spark, sf_dir, "part").select(
        k.alias("row_ord"), F.concat(F.lit("g"), k.cast("string")).alias("row_id"), F.lit(-27.4).alias("lat_a"), (F.lit(152.7) + k * F.lit(0.0015)).alias("lon_a"),
        (k * 37 % 360 + 0.25).alias("azimuth"), (k % 3 + 1).cast("double").alias("pos"), F.lit(3.0).alias("pos_total"),
    )
    return planted_rows(anchors, PLANTED)


@query(
    """WITH slots AS (SELECT p_partkey AS k, unnest(generate_series(1, 56)) AS slot FROM part),
    turned AS (SELECT *, (k * 37 % 360 + 0.25) BETWEEN 90 AND 270 AS at_start FROM slots),
    counted AS (SELECT *, CASE WHEN at_start THEN slot ELSE 57 - slot END AS position FROM turned)
    SELECT 'g' || k AS row_id, CAST(slot AS INT) AS slot, CAST(position AS INT) AS position, CAST(CASE WHEN position > 28 AND k % 3 < 2 THEN 57 - position ELSE (position - 1) % 28 + 1 END AS INT) AS module,
    CAST((position - 1) // 28 + 1 AS DOUBLE) AS string_number, CASE WHEN position > 28 AND k % 3 < 2 THEN 'far-end' ELSE 'near-dc' END AS counted_from, CAST(abs(slot % 7 - 3) * 50 AS BIGINT) AS distance_mm FROM counted""",
    base=False,
)
def slot_round_trip(spark, sf_dir):
    """Every slot of rows that are generated from anchor, azimuth and layout, put aside by up to 15 cm, is located again."""
    rows = planted(spark, sf_dir)
    made = slots(rows, PLANTED, aside=(F.col("slot") % 7 - 3) * F.lit(0.05))
    made = made.select(F.col("row_ord").alias("_row"), "slot", (F.col("row_ord") * 100 + F.col("slot")).alias("fix_id"), "lat", "lon", F.lit(0.3).alias("accuracy"))
    best = L.best_modules(L.near_rows(made, rows, PLANTED), PLANTED)
    return best.select("row_id", "slot", "position", "module", "string_number", "counted_from", mm(F.col("module_distance")).alias("distance_mm"))


CROWDED = SQL_BASE.replace("(event_id * 104729 % 100003) * CAST(0.000001 AS DOUBLE)", "CASE WHEN event_id % 10 < 9 THEN event_id * 104729 % 307 ELSE event_id * 104729 % 100003 END * CAST(0.000001 AS DOUBLE)")


@query(CROWDED + "SELECT fix_id, row_id, CAST(round(distance * 1000) AS BIGINT) AS distance_mm FROM pairs", base=False)
def adaptive_range_join(spark, sf_dir):
    """The pairs of a range join where nine fixes in ten crowd into 30 metres, by a grid that divides there."""
    e = F.col("fix_id")
    crowd = fixes(spark, sf_dir).withColumn("lon", F.lit(152.7000003) + F.when(e % 10 < 9, e * 104729 % 307).otherwise(e * 104729 % 100003) * F.lit(0.000001))
    pairs = adaptive_rows_in_range(crowd, C.compile_rows(tracker_rows(spark, sf_dir), FARM), FARM, least=200)
    return pairs.select("fix_id", "row_id", mm(F.col("distance")).alias("distance_mm"))


@query(
    SQL_BASE.split("pairs AS (")[0].replace("'r' || p_partkey AS row_id", "'r' || p_partkey // 2 AS row_id") + "pairs AS (" + SQL_BASE.split("pairs AS (")[1].replace("FROM spread)", "FROM (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY fix_id, row_id, position ORDER BY row_rank) = 1))")
    + "SELECT fix_id, row_ord, row_id, position, CAST(rank AS INT) AS rank, CAST(round(confidence * 1000) AS BIGINT) AS confidence_pm FROM found",
    base=False,
)
def locate_repeated_ids(spark, sf_dir):
    """Candidates where two rows share each id: of a position that both have the nearer row's stays."""
    rows = tracker_rows(spark, sf_dir).withColumn("row_id", F.concat(F.lit("r"), F.floor(F.col("row_ord") / 2).cast("string")))
    return L.locate(fixes(spark, sf_dir), rows, FARM).select("fix_id", "row_ord", "row_id", "position", "rank", F.round(F.col("confidence") * 1000).cast("long").alias("confidence_pm"))


@query("SELECT fix_id, CASE WHEN coalesce(accuracy, 0) < 1 THEN 1 ELSE CAST(floor(accuracy + 0.5) AS BIGINT) END AS metres FROM fixes")
def device_accuracy(spark, sf_dir):
    """What a receiver says of its accuracy, in whole metres and one at least."""
    return fixes(spark, sf_dir).select("fix_id", F.greatest(F.lit(1), F.floor(F.coalesce("accuracy", F.lit(0.0)) + 0.5)).alias("metres"))
