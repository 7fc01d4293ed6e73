"""Registered queries on coordinate text, spreadsheet rows, string lists, checks and profiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coords import parse_coordinate
from ..functions.geo import utm_to_wgs84, wgs84_to_utm
from ..operators.checks import check_summary, profile_issues
from ..operators import strings as S
from ..operators.sheets import build_rows, capabilities, skip_summary
from .driver import ORACLES, QUERIES, e7, fixes, query, read

COORDINATES = """CASE p_partkey % 8 WHEN 0 THEN '-' || p_partkey % 90 || '.5, ' || p_partkey % 180 || '.25' WHEN 1 THEN p_partkey % 90 || '°30''15.6"S ' || p_partkey % 180 || '°45''0"E'
    WHEN 2 THEN 'E ' || p_partkey % 180 || ' 30 S ' || p_partkey % 90 || ' 15' WHEN 3 THEN p_partkey % 90 || ' 30 36 ' || p_partkey % 180 || ' 15 36'
    WHEN 4 THEN '-' || p_partkey % 90 || '.5 S ' || p_partkey % 180 || ' W' WHEN 5 THEN p_name WHEN 6 THEN p_partkey % 90 || ' 75 N 10 E' ELSE (91 + p_partkey % 9) || ' ' || p_partkey END"""


@query(
    """SELECT p_partkey, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7, CAST(round(lon * 1e7) AS BIGINT) AS lon_e7, error FROM (SELECT p_partkey,
    CASE p_partkey % 8 WHEN 0 THEN -(a + CAST(0.5 AS DOUBLE)) WHEN 1 THEN -(a + CAST(0.5 AS DOUBLE) + CAST(15.6 AS DOUBLE) / 3600) WHEN 2 THEN -(a + CAST(0.25 AS DOUBLE)) WHEN 3 THEN a + CAST(0.51 AS DOUBLE) WHEN 4 THEN a + CAST(0.5 AS DOUBLE) END AS lat,
    CASE p_partkey % 8 WHEN 0 THEN o + CAST(0.25 AS DOUBLE) WHEN 1 THEN o + CAST(0.75 AS DOUBLE) WHEN 2 THEN o + CAST(0.5 AS DOUBLE) WHEN 3 THEN o + CAST(0.26 AS DOUBLE) WHEN 4 THEN -o END AS lon,
    CASE p_partkey % 8 WHEN 5 THEN 'syntax' WHEN 6 THEN 'range' WHEN 7 THEN 'range' END AS error FROM (SELECT p_partkey, p_partkey % 90 AS a, p_partkey % 180 AS o FROM part))""",
    base=False,
)
def coordinate_parse(spark, sf_dir):
    c = parse_coordinate(F.expr(COORDINATES))
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", e7(F.col("c.lat")).alias("lat_e7"), e7(F.col("c.lon")).alias("lon_e7"), "c.error")


@query("SELECT fix_id, 56 AS zone, true AS south, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7, CAST(round(lon * 1e7) AS BIGINT) AS lon_e7 FROM fixes")
def utm_roundtrip(spark, sf_dir):
    east, north, zone, south = wgs84_to_utm(F.col("lat"), F.col("lon"))
    df = fixes(spark, sf_dir).select("fix_id", east.alias("e"), north.alias("n"), zone.alias("zone"), south.alias("south"))
    lat, lon = utm_to_wgs84(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return df.select("fix_id", "zone", "south", e7(lat).alias("lat_e7"), e7(lon).alias("lon_e7"))


def sheet(spark, sf_dir):
    """A sheet of text cells from orders, with empty coordinates, empty blocks and stakes at one point among them."""
    k = F.col("o_orderkey") * 31 + F.col("o_custkey")
    text = lambda c: c.cast("string")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("152,"), text(k % 9000 + 1000))).alias("start_x"),
        F.lit("-27.4").alias("start_y"),
        F.concat(F.lit("152,"), text(k % 9000 + 1000)).alias("end_x"),
        F.when(k % 5 == 0, "-27.4").otherwise("-27.5").alias("end_y"),
        F.when(k % 3 == 0, " ").otherwise(text(k % 10)).alias("block"),
        text(k % 100).alias("tracker"),
        F.when(k % 2 == 0, "R1").alias("tracker_row"),
        F.when(k % 2 == 0, "Norte").when(k % 3 == 1, " s").otherwise("?").alias("side"),
    )


SHEET = """WITH sheet AS (SELECT ord, CASE WHEN k % 7 = 0 THEN 'missing-coordinates' WHEN k % 3 = 0 THEN 'missing-block-or-tracker' WHEN k % 5 = 0 THEN 'same-point' END AS reason,
    k % 10 || '-' || k % 100 || CASE WHEN k % 2 = 0 THEN '-R1' ELSE '' END AS base, CASE WHEN k % 2 = 0 THEN 'north' WHEN k % 3 = 1 THEN 'south' END AS side
    FROM (SELECT o_orderkey AS ord, o_orderkey * 31 + o_custkey AS k FROM orders)) """


@query(SHEET + "SELECT ord, reason, side, CASE WHEN reason IS NULL THEN base || CASE WHEN n > 1 THEN '#' || n ELSE '' END END AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, base ORDER BY ord) AS n FROM sheet)", base=False)
def sheet_rows(spark, sf_dir):
    return build_rows(sheet(spark, sf_dir)).select("ord", "reason", "side", "row_id")


@query(
    SHEET + "SELECT reason, count(*) AS n, min(ord) AS first, max(ord) AS last, max(CASE WHEN i = c // 2 THEN ord END) AS middle, max(ord) - min(ord) + 1 = count(*) AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY reason) AS c FROM sheet WHERE reason IS NOT NULL) GROUP BY reason",
    base=False,
)
def sheet_skips(spark, sf_dir):
    return skip_summary(build_rows(sheet(spark, sf_dir)).where("reason IS NOT NULL"))


@query(
    """SELECT unnest([{'capability': 'position', 'percent': 100, 'available': true}, {'capability': 'row-label', 'percent': CAST(floor(a * 100 / n + 0.5) AS INT), 'available': a > 0}, {'capability': 'origin-end', 'percent': CAST(floor(b * 100 / n + 0.5) AS INT), 'available': b = n},
    {'capability': 'string-of-row', 'percent': CAST(floor(c * 100 / n + 0.5) AS INT), 'available': c = n}, {'capability': 'string-number', 'percent': 0, 'available': false}, {'capability': 'serial', 'percent': 0, 'available': false}], recursive := true)
    FROM (SELECT count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS a, count(*) FILTER (p_size % 3 > 0) AS b, count(*) FILTER (p_size > 0) AS c FROM part)""",
    base=False,
)
def capability_report(spark, sf_dir):
    s = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(F.when(s % 2 == 0, "R1").alias("row_label"), F.when(s % 3 > 0, "north").alias("side"), F.when(s > 0, s).alias("pos"), s.alias("pos_total"), F.array().cast("array<double>").alias("strings"))
    return capabilities(rows)


MATCH = """WITH entries AS (SELECT o_orderkey AS ord, CAST(o_orderkey % 50 AS VARCHAR) AS block, CAST(o_orderkey // 50 % {trackers} AS VARCHAR) AS tracker, {entry_row} AS label_row FROM orders),
rows AS (SELECT p_partkey AS row_ord, 'r' || p_partkey AS row_id, CAST(p_partkey % 50 AS VARCHAR) AS block, CAST(p_partkey // 50 % 30 AS VARCHAR) AS tracker, {row_row} AS label_row FROM part),
keys_e AS (SELECT ord, 1 AS tier, block || '|' || tracker || '|' || label_row AS key FROM entries UNION ALL SELECT ord, 2, block || '|' || tracker FROM entries UNION ALL SELECT ord, 3, tracker || '|' || label_row FROM entries UNION ALL SELECT ord, 4, tracker FROM entries),
keys_r AS (SELECT row_id, 1 AS tier, block || '|' || tracker || '|' || label_row AS key FROM rows UNION ALL SELECT row_id, 2, block || '|' || tracker FROM rows UNION ALL SELECT row_id, 3, tracker || '|' || label_row FROM rows UNION ALL SELECT row_id, 4, tracker FROM rows),
once AS (SELECT tier, key, min(row_id) AS row_id FROM keys_r WHERE key IS NOT NULL GROUP BY tier, key HAVING count(*) = 1),
labels AS (SELECT block, tracker, label_row, min(ord) AS seen, coalesce(CAST(nullif(regexp_extract(label_row, '[0-9]+'), '') AS DOUBLE), CAST('inf' AS DOUBLE)) AS number FROM entries WHERE label_row IS NOT NULL GROUP BY block, tracker, label_row),
ours AS (SELECT *, row_number() OVER (PARTITION BY block, tracker ORDER BY number, seen) AS i, count(*) OVER (PARTITION BY block, tracker) AS n FROM labels),
theirs AS (SELECT *, row_number() OVER (PARTITION BY block, tracker ORDER BY CASE label_row WHEN 'motorizada' THEN 1 WHEN 'esclava' THEN 2 ELSE 3 END, row_ord) AS i, count(*) OVER (PARTITION BY block, tracker) AS n FROM rows),
pairs AS (SELECT o.block, o.tracker, o.label_row, t.row_id, t.row_ord, t.label_row AS geometry_row, o.i, o.n FROM ours o JOIN theirs t USING (block, tracker, i, n)),
found AS (SELECT tier, ord, row_id FROM keys_e JOIN once USING (tier, key) UNION ALL SELECT 5, ord, row_id FROM entries JOIN pairs USING (block, tracker, label_row)),
best AS (SELECT tier FROM found GROUP BY tier ORDER BY count(*) DESC, tier LIMIT 1),
matches AS (SELECT tier, ord, row_id FROM found JOIN best USING (tier)) """
BY_NAME = MATCH.format(trackers=40, entry_row="'r' || (o_orderkey % 4)", row_row="CASE WHEN p_partkey % 5 > 0 THEN 'r' || (p_partkey % 3) END")
BY_ORDER_SQL = MATCH.format(trackers=30, entry_row="'r' || (2 + o_orderkey // 1500 % 2)", row_row="CASE WHEN p_partkey // 1500 % 2 = 1 THEN 'motorizada' ELSE 'esclava' END")


def match_entries_of(spark, sf_dir, by_order=False):
    """Entries from orders: ord, label, tracker, tracker_row, dc_box and their reference."""
    k = F.col("o_orderkey")
    label = F.concat(F.lit("R"), (2 + F.floor(k / 1500) % 2).cast("string")) if by_order else F.concat(F.lit("R"), (k % 4).cast("string"))
    tracker = F.concat_ws("-", (k % 50).cast("string"), F.lpad((F.floor(k / 50) % (30 if by_order else 40)).cast("string"), 3, "0"))
    sheet = read(spark, sf_dir, "orders").select(k.alias("ord"), F.format_string("S-%d.%d", k % 9, k).alias("label"), tracker.alias("tracker"), label.alias("tracker_row"), F.when(k % 3 == 0, F.concat(F.lit("DC"), (k % 17).cast("string"))).otherwise(" ").alias("dc_box"))
    return S.read_entries(sheet)


def match_rows_of(spark, sf_dir, by_order=False):
    k = F.col("p_partkey")
    label = F.when(F.floor(k / 1500) % 2 == 1, "Motorizada").otherwise("ESCLAVA") if by_order else F.when(k % 5 > 0, F.concat(F.lit("R"), (k % 3).cast("string")))
    rows = read(spark, sf_dir, "part").select(k.alias("row_ord"), F.concat(F.lit("r"), k.cast("string")).alias("row_id"), (k % 50).cast("string").alias("block"), (F.floor(k / 50) % 30).cast("string").alias("tracker"), label.alias("tracker_row"))
    return S.row_keys(rows)


def matched(spark, sf_dir, by_order=False):
    entries = match_entries_of(spark, sf_dir, by_order)
    return S.match_entries(entries.withColumn("tracker", F.col("tracker_no")), match_rows_of(spark, sf_dir, by_order))


@query(BY_NAME + "SELECT * FROM matches", base=False)
def string_match(spark, sf_dir):
    return matched(spark, sf_dir)


@query(BY_ORDER_SQL + "SELECT * FROM matches", base=False)
def string_match_by_order(spark, sf_dir):
    """Labels and rows that share no vocabulary: the n-th label of a tracker goes to its n-th row."""
    return matched(spark, sf_dir, by_order=True)


@query(
    "SELECT *, CASE WHEN matches = 0 THEN 'unverified' WHEN near_dc AND far_end AND sides AND mismatches = 0 THEN 'field-verified' ELSE 'partial' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS matches, count(*) FILTER (o_orderstatus = 'P') AS mismatches, "
    "count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) > 0 AS near_dc, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 1) > 0 AS far_end, count(DISTINCT o_orderkey % 2) FILTER (o_orderstatus = 'F') >= 2 AS sides FROM orders)",
    base=False,
)
def check_coverage(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    side = F.when(k % 2 == 0, "north").otherwise("south").alias("side")
    orders = read(spark, sf_dir, "orders")
    checks = orders.select(F.when(s == "F", "match").when(s == "P", "mismatch").otherwise("open").alias("outcome"), F.when(k % 3 == 0, "near-dc").when(k % 3 == 1, "far-end").alias("counted_from"), side)
    return check_summary(checks, orders.select(side))


@query(
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'name' END, CASE WHEN p_partkey % 3 = 0 THEN 'module.widthMm' END, CASE WHEN p_partkey % 7 = 0 THEN 'module.pitchMm' END, CASE WHEN p_partkey % 4 = 0 THEN 'topology.stringsPerRow' END,
    CASE WHEN p_partkey % 4 = 3 THEN 'addressing.piercing-chain' END, CASE WHEN p_partkey % 5 = 0 THEN 'crs.zone' END) AS issues FROM part""",
    base=False,
)
def profile_validation(spark, sf_dir):
    profiles = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "'farm' AS id", "IF(p_partkey % 2 = 0, ' ', 'Farm') AS name", "1 AS profileVersion",
        "named_struct('widthMm', IF(p_partkey % 3 = 0, 0D, 1130D), 'gapMm', 20D, 'pitchMm', IF(p_partkey % 7 = 0, 'no', 'derive')) AS module",
        "named_struct('modulesPerString', 28, 'stringsPerRow', CAST(p_partkey % 4 AS INT), 'stringGapMm', 3713D) AS topology",
        "named_struct('endpointOffsetMm', -1464D, 'endpointOffsetMode', 'both') AS geometry",
        "named_struct('originStrategy', 'dc-box-end', 'inversionStrategy', 'piercing-chain', 'fixedEnd', CAST(NULL AS STRING)) AS addressing",
        "named_struct('type', 'utm', 'zone', IF(p_partkey % 5 = 0, 61, 56), 'hemisphere', 'S') AS crs",
    )
    return profile_issues(profiles).select("p_partkey", F.concat_ws(",", "issues").alias("issues"))


__all__ = ["ORACLES", "QUERIES"]
