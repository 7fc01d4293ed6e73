"""Registered queries over the driver's tables, and their SQL.

Tracker rows come from `part`, fixes from `events`, by arithmetic on their keys: blocks of 12 columns on both sides of a road.
Lengths leave as whole millimetres, coordinates as 1e-7 degrees and confidences per mille, so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import project, to_geo, to_local, utm_to_wgs84, wgs84_to_utm
from ..functions.layout import Layout
from ..functions.text import numeric_fields, to_number, tracker_ref
from ..operators import compiled as C
from ..operators import locate as L
from ..operators import tables as T
from ..operators.sheets import guess_crs

FARM = C.Farm(lat=-27.4, lon=152.7)
LAYOUT = Layout()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mm(c: Column) -> Column:
    return F.round(c * 1000).cast("long")


def e7(c: Column) -> Column:
    return F.round(c * 1e7).cast("long")


def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    north = k % 24 < 12
    lon = F.lit(152.7) + (k % 12) * F.lit(0.00006) + F.floor(k / 24) * F.lit(0.0012)
    return read(spark, sf_dir, "part").select(
        k.alias("row_ord"),
        F.concat(F.lit("r"), k.cast("string")).alias("row_id"),
        F.floor(k / 24).alias("block"),
        F.when(north, F.lit(-27.4 + 0.000624)).otherwise(F.lit(-27.4 - 0.000036)).alias("lat_a"),
        lon.alias("lon_a"),
        F.when(north, F.lit(-27.4 + 0.000036)).otherwise(F.lit(-27.4 - 0.000624)).alias("lat_b"),
        lon.alias("lon_b"),
        F.when(north, "north").otherwise("south").alias("side"),
        (k % 3 + 1).alias("pos"),
        F.lit(3).alias("pos_total"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("fix_id"),
        (F.lit(-27.4) + (e * 7919 % 1500 - 750) * F.lit(0.000001)).alias("lat"),
        (F.lit(152.7000003) + (e * 104729 % 100003) * F.lit(0.000001)).alias("lon"),
        F.when(e % 3 == 0, 0.5).when(e % 3 == 1, 3.0).alias("accuracy"),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.locate(fixes(spark, sf_dir), tracker_rows(spark, sf_dir), FARM)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rows_in_range(fixes(spark, sf_dir), C.compile_rows(tracker_rows(spark, sf_dir), FARM), FARM)


A, E2 = 6378137.0, (1 / 298.257223563) * (2 - 1 / 298.257223563)
SQL_BASE = f"""
WITH tracker_rows AS (SELECT p_partkey AS row_ord, 'r' || p_partkey AS row_id, p_partkey // 24 AS block, p_partkey % 24 < 12 AS north,
    CASE WHEN p_partkey % 24 < 12 THEN CAST(-27.4 AS DOUBLE) + CAST(0.000624 AS DOUBLE) ELSE CAST(-27.4 AS DOUBLE) - CAST(0.000036 AS DOUBLE) END AS lat_a,
    CASE WHEN p_partkey % 24 < 12 THEN CAST(-27.4 AS DOUBLE) + CAST(0.000036 AS DOUBLE) ELSE CAST(-27.4 AS DOUBLE) - CAST(0.000624 AS DOUBLE) END AS lat_b,
    CAST(152.7 AS DOUBLE) + (p_partkey % 12) * CAST(0.00006 AS DOUBLE) + (p_partkey // 24) * CAST(0.0012 AS DOUBLE) AS lon, p_partkey % 3 + 1 AS pos FROM part),
fixes AS (SELECT event_id AS fix_id, CAST(-27.4 AS DOUBLE) + (event_id * 7919 % 1500 - 750) * CAST(0.000001 AS DOUBLE) AS lat,
    CAST(152.7000003 AS DOUBLE) + (event_id * 104729 % 100003) * CAST(0.000001 AS DOUBLE) AS lon,
    CASE event_id % 3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(3.0 AS DOUBLE) END AS accuracy FROM events),
scale AS (SELECT {A} / sqrt(w) * cos(radians(CAST(-27.4 AS DOUBLE))) AS east, {A * (1 - E2)} / (w * sqrt(w)) AS north_m
  FROM (SELECT 1 - {E2} * sin(radians(CAST(-27.4 AS DOUBLE))) * sin(radians(CAST(-27.4 AS DOUBLE))) AS w)),
local_fixes AS (SELECT f.*, radians(lon - CAST(152.7 AS DOUBLE)) * east AS x, radians(lat - CAST(-27.4 AS DOUBLE)) * north_m AS y FROM fixes f, scale),
compiled AS (SELECT r.*, radians(lon - CAST(152.7 AS DOUBLE)) * east AS ax, radians(lat_a - CAST(-27.4 AS DOUBLE)) * north_m AS ay,
    radians(lat_b - CAST(-27.4 AS DOUBLE)) * north_m AS bys FROM tracker_rows r, scale),
pairs AS (SELECT f.fix_id, f.lat, f.lon, f.accuracy, f.x, f.y, c.row_ord, c.row_id, c.north, c.pos, c.ax, c.ay, c.ay - c.bys AS length, c.ay - f.y AS along, abs(f.x - c.ax) AS off_axis,
    sqrt((f.x - c.ax) * (f.x - c.ax) + (f.y - c.ay + least(greatest(c.ay - f.y, 0), c.ay - c.bys)) * (f.y - c.ay + least(greatest(c.ay - f.y, 0), c.ay - c.bys))) AS distance
  FROM local_fixes f JOIN compiled c ON f.x BETWEEN c.ax - 30 AND c.ax + 30 AND f.y BETWEEN c.bys - 30 AND c.ay + 30),
near AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY distance, row_ord) AS row_rank FROM pairs WHERE distance <= 30 QUALIFY row_rank <= 3),
hits AS (SELECT *, coalesce(accuracy, CAST(3 AS DOUBLE)) AS sigma, (CASE WHEN north THEN length - along ELSE along END) + CAST(1.464 AS DOUBLE) AS d FROM near),
strings AS (SELECT *, least(greatest(floor(d / CAST(35.893 AS DOUBLE)), 0), 1) AS s FROM hits),
centres AS (SELECT *, d - s * CAST(35.893 AS DOUBLE) AS within FROM strings),
placed AS (SELECT *, CAST(least(greatest(s * 28 + floor(within / CAST(1.15 AS DOUBLE)) + 1, 1), 56) AS INT) AS centre, within > CAST(32.18 AS DOUBLE) AND s < 1 AS in_gap,
    s * 28 + within / CAST(1.15 AS DOUBLE) + 1 AS raw, CAST(least(12, greatest(2, ceil(2 * sigma / CAST(1.15 AS DOUBLE)))) AS INT) AS reach FROM centres),
spread AS (SELECT *, unnest(generate_series(greatest(1, centre - reach), least(56, centre + reach))) AS position FROM placed),
modules AS (SELECT *, (position - 1) // 28 AS chunk, CAST(-1.464 AS DOUBLE) + ((position - 1) // 28) * CAST(35.893 AS DOUBLE) + ((position - 1) % 28) * CAST(1.15 AS DOUBLE) + CAST(0.565 AS DOUBLE) AS mid FROM spread),
centred AS (SELECT *, pos < 3 AND chunk > 0 AS turned, ay - (CASE WHEN north THEN length - mid ELSE mid END) AS my FROM modules),
measured AS (SELECT *, sqrt((x - ax) * (x - ax) + (y - my) * (y - my)) AS module_distance, CAST(CASE WHEN turned THEN 29 - ((position - 1) % 28 + 1) ELSE (position - 1) % 28 + 1 END AS INT) AS module FROM centred),
weighed AS (SELECT *, exp(-0.5 * power(module_distance / sigma, 2)) AS weight FROM measured),
found AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY fix_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY fix_id) ELSE 0 END AS confidence,
    row_number() OVER (PARTITION BY fix_id ORDER BY module_distance, row_rank, position) AS rank FROM weighed)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (SQL_BASE if base else "") + sql
        return f

    return add


@query("SELECT fix_id, CAST(round(x * 1000) AS BIGINT) AS x_mm, CAST(round(y * 1000) AS BIGINT) AS y_mm FROM local_fixes")
def frame_to_local(spark, sf_dir):
    x, y = to_local(F.col("lat"), F.col("lon"), F.lit(FARM.lat), F.lit(FARM.lon))
    return fixes(spark, sf_dir).select("fix_id", mm(x).alias("x_mm"), mm(y).alias("y_mm"))


@query("SELECT fix_id, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7, CAST(round(lon * 1e7) AS BIGINT) AS lon_e7 FROM fixes")
def frame_roundtrip(spark, sf_dir):
    lat0, lon0 = F.lit(FARM.lat), F.lit(FARM.lon)
    lat, lon = to_geo(*to_local(F.col("lat"), F.col("lon"), lat0, lon0), lat0, lon0)
    return fixes(spark, sf_dir).select("fix_id", e7(lat).alias("lat_e7"), e7(lon).alias("lon_e7"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(round(((l_quantity * 2 + l_extendedprice / 100 * 5) / sqrt(29)) * 1000) AS BIGINT) AS along_mm, "
    "CAST(round(abs(l_quantity * 5 - l_extendedprice / 100 * 2) / sqrt(29) * 1000) AS BIGINT) AS off_mm FROM lineitem",
    base=False,
)
def segment_projection(spark, sf_dir):
    along, off = project(F.col("l_quantity"), F.col("l_extendedprice") / 100, F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(5.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mm(along).alias("along_mm"), mm(off).alias("off_mm"))


@query(
    "SELECT p_partkey, CAST(least(greatest(s * 28 + floor((d - s * CAST(35.893 AS DOUBLE)) / CAST(1.15 AS DOUBLE)) + 1, 1), 56) AS INT) AS position, "
    "d - s * CAST(35.893 AS DOUBLE) > CAST(32.18 AS DOUBLE) AND s < 1 AS in_gap FROM (SELECT *, least(greatest(floor(d / CAST(35.893 AS DOUBLE)), 0), 1) AS s "
    "FROM (SELECT p_partkey, p_partkey % 701 / CAST(10 AS DOUBLE) + CAST(1.464 AS DOUBLE) AS d FROM part))",
    base=False,
)
def position_at_distance(spark, sf_dir):
    position, in_gap, _ = LAYOUT.position_at(F.col("p_partkey") % 701 / 10)
    return read(spark, sf_dir, "part").select("p_partkey", position.alias("position"), in_gap.alias("in_gap"))


@query(
    "SELECT p_partkey, CAST(round((CAST(-1.464 AS DOUBLE) + (p_partkey % 56 // 28) * CAST(35.893 AS DOUBLE) + (p_partkey % 56 % 28) * CAST(1.15 AS DOUBLE) + CAST(0.565 AS DOUBLE)) * 1000) AS BIGINT) AS centre_mm FROM part",
    base=False,
)
def distance_at_position(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", mm(LAYOUT.distance_at(F.col("p_partkey") % 56 + 1)).alias("centre_mm"))


@query("SELECT row_id, CASE WHEN north THEN 'end' ELSE 'start' END AS origin_end, pos < 3 AS inverted, CAST(round((ay - bys) * 1000) AS BIGINT) AS length_mm FROM compiled")
def compile_farm(spark, sf_dir):
    c = C.compile_rows(tracker_rows(spark, sf_dir), FARM)
    return c.select("row_id", "origin_end", F.get("inverted", F.lit(1)).alias("inverted"), mm(F.col("length")).alias("length_mm"))


@query("SELECT CAST(round(avg((lat_a + lat_b) / 2) * 1e7) AS BIGINT) AS lat_e7, CAST(round(avg(lon) * 1e7) AS BIGINT) AS lon_e7 FROM tracker_rows")
def farm_centroid(spark, sf_dir):
    return C.centroid(tracker_rows(spark, sf_dir)).select(e7(F.col("lat")).alias("lat_e7"), e7(F.col("lon")).alias("lon_e7"))


@query("SELECT fix_id, row_id, CAST(round(distance * 1000) AS BIGINT) AS distance_mm FROM pairs")
def bbox_range_join(spark, sf_dir):
    return pairs(spark, sf_dir).select("fix_id", "row_id", mm(F.col("distance")).alias("distance_mm"))


@query("SELECT fix_id, row_id, CAST(row_rank AS INT) AS row_rank, CAST(round(distance * 1000) AS BIGINT) AS distance_mm FROM near")
def nearest_rows_topk(spark, sf_dir):
    return L.nearest_rows(pairs(spark, sf_dir), FARM).select("fix_id", "row_id", "row_rank", mm(F.col("distance")).alias("distance_mm"))


@query("SELECT fix_id, row_id, position, module, CASE WHEN turned THEN 'far-end' ELSE 'near-dc' END AS counted_from, CAST(round(module_distance * 1000) AS BIGINT) AS distance_mm FROM found WHERE rank = 1")
def locate_best(spark, sf_dir):
    best = L.best_modules(L.near_rows(fixes(spark, sf_dir), tracker_rows(spark, sf_dir), FARM), FARM)
    return best.select("fix_id", "row_id", "position", "module", "counted_from", mm(F.col("module_distance")).alias("distance_mm"))


@query("SELECT fix_id, row_id, CAST(chunk AS INT) AS chunk, position, module, CAST(rank AS INT) AS rank, CAST(round(confidence * 1000) AS BIGINT) AS confidence_pm FROM found")
def locate_candidates(spark, sf_dir):
    return located(spark, sf_dir).select("fix_id", "row_id", "chunk", "position", "module", "rank", F.round(F.col("confidence") * 1000).cast("long").alias("confidence_pm"))


@query(
    ", tops AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER w AS top, max(CASE WHEN rank = 1 THEN row_id END) OVER w AS top_row, max(CASE WHEN rank = 1 THEN chunk END) OVER w AS top_chunk FROM found WINDOW w AS (PARTITION BY fix_id)) "
    "SELECT fix_id, concat_ws(',', CASE WHEN bool_or(row_rank = 1 AND in_gap) THEN 'in-string-gap' END, CASE WHEN bool_or(row_rank = 1 AND (raw < 1 OR raw > 56)) THEN 'outside-row-extent' END, "
    "CASE WHEN any_value(top) < 0.35 THEN 'low-confidence' END, CASE WHEN bool_or(rank > 1 AND confidence > 0.6 * top AND (row_id <> top_row OR chunk <> top_chunk)) THEN 'ambiguous' END) AS codes FROM tops GROUP BY fix_id"
)
def locate_warnings(spark, sf_dir):
    return L.warnings(located(spark, sf_dir))


@query("SELECT fix_id, 'no-row-within-range' AS code FROM fixes WHERE fix_id NOT IN (SELECT fix_id FROM near)")
def locate_no_match(spark, sf_dir):
    return L.without_rows(fixes(spark, sf_dir), tracker_rows(spark, sf_dir), FARM)


@query(
    ", own AS (SELECT *, max(CASE WHEN rank = 1 THEN row_id END) OVER (PARTITION BY fix_id) AS top_row FROM found), "
    "runs AS (SELECT *, coalesce(sum(confidence) OVER (PARTITION BY fix_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM own WHERE row_id = top_row) "
    "SELECT fix_id, min(position) AS first, max(position) AS last, min(module) AS low_module, max(module) AS high_module, count(DISTINCT chunk) = 1 AS one_string, CAST(arg_min(chunk, rank) + 1 AS DOUBLE) AS string_number FROM runs WHERE before < 0.85 GROUP BY fix_id"
)
def credible_range(spark, sf_dir):
    return L.credible_range(located(spark, sf_dir))


NUMBERS = "CASE p_partkey % 6 WHEN 0 THEN '1.234,' || p_partkey % 100 WHEN 1 THEN '1,234.' || p_partkey % 100 WHEN 2 THEN '-27,' || (100 + p_partkey % 900) WHEN 3 THEN '6 965 ' || (100 + p_partkey % 900) WHEN 4 THEN p_name ELSE '-' || p_partkey || ',5' END"


@query(
    f"""SELECT p_partkey, CAST(round(1000 * TRY_CAST(CASE p_partkey % 6 WHEN 0 THEN '1234.' || p_partkey % 100 WHEN 1 THEN '1234.' || p_partkey % 100 WHEN 2 THEN '-27' || (100 + p_partkey % 900)
    WHEN 3 THEN '6965' || (100 + p_partkey % 900) WHEN 4 THEN NULL ELSE '-' || p_partkey || '.5' END AS DOUBLE)) AS BIGINT) AS milli FROM part""",
    base=False,
)
def number_parse(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(NUMBERS).alias("t")).select("p_partkey", mm(to_number(F.col("t"))).alias("milli"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 24 AS VARCHAR) END AS block, CAST(p_partkey AS VARCHAR) AS tracker, CASE WHEN p_partkey % 2 = 0 THEN 'R' || (p_partkey % 3) END AS tracker_row FROM part",
    base=False,
)
def tracker_ref_parse(spark, sf_dir):
    text = F.expr("CASE WHEN p_partkey % 2 = 0 THEN '0' || p_partkey % 24 || '-00' || p_partkey || '-R' || p_partkey % 3 ELSE '00' || p_partkey END")
    block, tracker, row = tracker_ref(F.col("t"))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", block.alias("block"), tracker.alias("tracker"), row.alias("tracker_row"))


@query(
    "SELECT field, count(DISTINCT n) AS n_distinct, min(n) AS low, max(n) AS high FROM (SELECT 0 AS field, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem UNION ALL SELECT 1, CAST(l_partkey AS DOUBLE) FROM lineitem) GROUP BY field",
    base=False,
)
def label_fields(spark, sf_dir):
    labels = read(spark, sf_dir, "lineitem").select(F.posexplode(numeric_fields(F.format_string("S-%d.%d", "l_linenumber", "l_partkey"))).alias("field", "n"))
    return labels.groupBy("field").agg(F.count_distinct("n").alias("n_distinct"), F.min("n").alias("low"), F.max("n").alias("high"))


@query(
    "SELECT l_orderkey, l_linenumber, last_value(b IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS box FROM (SELECT *, CASE WHEN l_linenumber % 3 = 1 THEN 'B' || l_linenumber END AS b FROM lineitem)",
    base=False,
)
def forward_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("box", F.expr("CASE WHEN l_linenumber % 3 = 1 THEN 'B' || l_linenumber ELSE ' ' END"))
    return T.forward_fill(rows, "box", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "box")


@query(
    "SELECT l_orderkey, l_linenumber, k, s_suppkey FROM (SELECT *, l_partkey % 150 AS k FROM lineitem) JOIN (SELECT s_suppkey % 70 AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) USING (k)",
    base=False,
)
def unique_key_match(spark, sf_dir):
    entries = read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 150).select("l_orderkey", "l_linenumber", "k")
    return T.unique_matches(entries, read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 70).alias("k"), "s_suppkey"), "k", "s_suppkey")


@query(
    "SELECT s_suppkey, CAST(s_suppkey AS BIGINT) AS version, 'kept' AS origin FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 UNION ALL SELECT s_suppkey, CAST(s_suppkey + 1000 AS BIGINT), 'incoming' FROM supplier WHERE s_suppkey % 3 = 0",
    base=False,
)
def geometry_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    before = rows.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_suppkey").alias("version"))
    return T.merge_rows(before, rows.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") + 1000).alias("version")), "s_suppkey")


@query(
    "SELECT o_orderkey, o_custkey || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)", base=False
)
def dedupe_ids(spark, sf_dir):
    return T.number_repeats(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "unique_id")


@query(
    "SELECT p_brand, count(*) AS n, max(CASE WHEN i = floor(c * 0.1) THEN p_retailprice END) AS p10, max(CASE WHEN i = floor(c * 0.5) THEN p_retailprice END) AS median, max(CASE WHEN i = floor(c * 0.9) THEN p_retailprice END) AS p90 "
    "FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS c FROM part) GROUP BY p_brand",
    base=False,
)
def length_order_stats(spark, sf_dir):
    return T.order_statistics(read(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query(
    "SELECT row_id, block, CAST(row_number() OVER (PARTITION BY block ORDER BY (ay + bys) / 2, row_ord) AS INT) AS pos, CAST(count(*) OVER (PARTITION BY block) AS INT) AS pos_total FROM (SELECT * REPLACE (round(ay, 6) AS ay, round(bys, 6) AS bys) FROM compiled)"
)
def chain_topology(spark, sf_dir):
    c = C.compile_rows(tracker_rows(spark, sf_dir), FARM).drop("pos", "pos_total")
    return T.chain_positions(c, "block", (F.round("ay", 6) + F.round("by", 6)) / 2, "row_ord").select("row_id", "block", "pos", "pos_total")


@query(
    ", steps AS (SELECT block, t, row_number() OVER w AS i, t - lag(t) OVER w AS gap FROM (SELECT block, row_ord, round((ay + bys) / 2, 3) AS t FROM compiled) WINDOW w AS (PARTITION BY block ORDER BY t, row_ord)) "
    "SELECT block, CAST(round(max(gap) * 1000) AS BIGINT) AS gap_mm, CAST(arg_max(i, gap * 1000000 - i) - 1 AS BIGINT) AS at FROM steps WHERE gap IS NOT NULL GROUP BY block"
)
def side_gap(spark, sf_dir):
    c = C.compile_rows(tracker_rows(spark, sf_dir), FARM)
    out = T.largest_gap(c, "block", F.round((F.col("ay") + F.col("by")) / 2, 3), "row_ord")
    return out.select("block", mm(F.col("gap")).alias("gap_mm"), F.col("at").cast("long").alias("at"))


@query(
    "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'P') AS discarded, count(*) FILTER (o_orderstatus = 'O') AS pending, count(DISTINCT o_custkey % 24) AS blocks FROM orders",
    base=False,
)
def inspection_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"), F.count_if(s == "F").alias("confirmed"), F.count_if(s == "P").alias("discarded"), F.count_if(s == "O").alias("pending"), F.count_distinct(F.col("o_custkey") % 24).alias("blocks")
    )


@query(
    """SELECT o_orderkey, concat_ws(',', CAST(o_orderkey AS VARCHAR), CASE WHEN regexp_matches(c, '[",;]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END) AS line FROM (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '; "x"' ELSE '' END AS c FROM orders WHERE o_orderstatus <> 'P')""",
    base=False,
)
def findings_csv(spark, sf_dir):
    cell = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.lit('; "x"')).otherwise(F.lit("")))
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.concat_ws(",", T.csv_cell(F.col("o_orderkey")), T.csv_cell(cell)).alias("line"))


@query(
    "SELECT crs, CASE WHEN crs = 'utm' THEN 56 END AS zone, CASE WHEN crs = 'utm' THEN CASE WHEN mean > 5000000 THEN 'S' ELSE 'N' END END AS hemisphere, shift FROM (SELECT shift, CASE WHEN bool_and(abs(y) <= 90 AND abs(x) <= 180) THEN 'wgs84' ELSE 'utm' END AS crs, avg(y) AS mean "
    "FROM (SELECT shift, c_acctbal / 1000 + shift AS x, c_acctbal / 1000 + shift AS y FROM customer, (SELECT unnest([0, 300000, 6000000]) AS shift) WHERE c_custkey < 40) GROUP BY shift)",
    base=False,
)
def crs_guess(spark, sf_dir):
    """Degrees, metres in the north and metres in the south."""
    y, out = F.col("c_acctbal") / 1000, None
    for shift in (0, 300_000, 6_000_000):
        places = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), (y + shift).alias("x"), (y + shift).alias("y"))
        one = guess_crs(places).withColumn("shift", F.lit(shift))
        out = one if out is None else out.unionByName(one)
    return out


def _series(coefficients, outer: str, inner: str, u: str, v: str) -> str:
    """A sum of coefficient * outer(2 j u) * inner(2 j v) in SQL; without an inner function only the first."""
    return " + ".join(f"CAST({c!r} AS DOUBLE) * {outer}({2 * j} * {u})" + (f" * {inner}({2 * j} * {v})" if inner else "") for j, c in enumerate(coefficients, 1))


@query(
    f"""SELECT p_partkey, CAST(round(degrees(chi + {_series(geo.DELTA, 'sin', '', 'chi', '')}) * 1e7) AS BIGINT) AS lat_e7, CAST(round((153 + degrees(atan2(sinh(v), cos(u)))) * 1e7) AS BIGINT) AS lon_e7
    FROM (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM (SELECT p_partkey, xi - ({_series(geo.BETA, 'sin', 'cosh', 'xi', 'eta')}) AS u, eta - ({_series(geo.BETA, 'cos', 'sinh', 'xi', 'eta')}) AS v
    FROM (SELECT p_partkey, (6965000 + p_partkey * 11 - 10000000) / CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) AS xi, (470000 + p_partkey * 7 - 500000) / CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) AS eta FROM part)))""",
    base=False,
)
def utm_inverse(spark, sf_dir):
    """UTM coordinates around a farm to degrees."""
    k = F.col("p_partkey")
    lat, lon = utm_to_wgs84(F.lit(470_000.0) + k * 7, F.lit(6_965_000.0) + k * 11, F.lit(56), F.lit(True))
    return read(spark, sf_dir, "part").select("p_partkey", e7(lat).alias("lat_e7"), e7(lon).alias("lon_e7"))


@query(
    f"""SELECT fix_id, CAST(round((CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) * (v + {_series(geo.ALPHA, 'cos', 'sinh', 'u', 'v')}) + 500000) * 100) AS BIGINT) AS east_cm, CAST(round((CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) * (u + {_series(geo.ALPHA, 'sin', 'cosh', 'u', 'v')}) + 10000000) * 100) AS BIGINT) AS north_cm
    FROM (SELECT fix_id, atan2(t, cos(turn)) AS u, atanh(sin(turn) / sqrt(1 + t * t)) AS v FROM (SELECT fix_id, radians(lon - 153) AS turn, sinh(atanh(sin(radians(lat))) - CAST({geo.E2**0.5!r} AS DOUBLE) * atanh(CAST({geo.E2**0.5!r} AS DOUBLE) * sin(radians(lat)))) AS t FROM fixes))"""
)
def utm_forward(spark, sf_dir):
    east, north, _, _ = wgs84_to_utm(F.col("lat"), F.col("lon"))
    return fixes(spark, sf_dir).select("fix_id", F.round(east * 100).cast("long").alias("east_cm"), F.round(north * 100).cast("long").alias("north_cm"))
