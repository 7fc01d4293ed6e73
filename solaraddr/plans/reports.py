"""Registered queries on headers, string lists, sides, merges, findings, checks and profiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..functions.text import described, fixed, header_words, slug
from ..operators import headers as H
from ..operators import merging as M
from ..operators import profiles as P
from ..operators import report as R
from ..operators import sides as D
from ..operators import strings as S
from ..operators import tables as T
from ..operators.sheets import build_rows, skip_samples, skip_summary
from ..operators.sheets import string_numbers as numbers_in
from . import batch  # noqa: F401
from .driver import ORACLES, QUERIES, mm, query, read
from .farms import LOCATED, located, slanted_fixes, slanted_rows
from .sheets import BY_NAME, BY_ORDER_SQL, SHEET, match_entries_of, match_rows_of, matched, sheet

# ---- headers -------------------------------------------------------------------------------------------------------------
HEADERS = """CASE p_partkey % 12 WHEN 0 THEN 'Pica 1 Norte (N)' WHEN 1 THEN 'PICA2_ESTE' WHEN 2 THEN 'Y_Norte' WHEN 3 THEN 'x final' WHEN 4 THEN 'Latitud inicio' WHEN 5 THEN 'lat lon 1'
    WHEN 6 THEN 'Norte sur' WHEN 7 THEN 'Longitúd B' WHEN 8 THEN 'este 1' WHEN 9 THEN 'Bloque' WHEN 10 THEN 'northing2' ELSE 'y desde hasta' END || CASE WHEN p_partkey % 24 < 12 THEN '' ELSE ' ' END"""


@query(
    "SELECT p_partkey, ['start_y', 'end_x', 'start_y', 'end_x', 'start_y', NULL, 'end_y', 'end_x', 'start_x', NULL, 'end_y', 'end_y'][p_partkey % 12 + 1] AS role FROM part", base=False
)
def header_roles(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", H.coordinate_role(F.expr(HEADERS)).alias("role"))


@query(
    """SELECT p_partkey, ['pica 1 norte n', 'pica 2 este', 'y norte', 'x final', 'latitud inicio', 'lat lon 1', 'norte sur', 'longitud b', 'este 1', 'bloque', 'northing 2', 'y desde hasta'][p_partkey % 12 + 1] AS words,
    ['pica-1-norte-n', 'pica2-este', 'y-norte', 'x-final', 'latitud-inicio', 'lat-lon-1', 'norte-sur', 'longitud-b', 'este-1', 'bloque', 'northing2', 'y-desde-hasta'][p_partkey % 12 + 1] AS slug, 'farm' AS default_slug FROM part""",
    base=False,
)
def header_tokens(spark, sf_dir):
    h = F.expr(HEADERS)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(header_words(h), " ").alias("words"), slug(h).alias("slug"), slug(F.lit(" - ")).alias("default_slug"))


@query("SELECT 'lines' AS sheet, unnest(['KEY', 'BLOQUE', 'Nota']) AS header, unnest([1, 2, 3]) AS place", base=False)
def header_discovery(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = F.when(k % 150 < 149, F.create_map(F.lit("KEY"), k.cast("string"), F.lit("BLOQUE"), F.lit("1"))).otherwise(F.create_map(F.lit("KEY"), k.cast("string"), F.lit("Nota"), F.lit("x")))
    return H.headers_of(read(spark, sf_dir, "orders").select(F.lit("lines").alias("sheet"), k.alias("ord"), cells.alias("cells"))).select("sheet", "header", "place")


@query(SHEET + "SELECT ord, reason, side, CASE WHEN reason IS NULL THEN base || CASE WHEN n > 1 THEN '#' || n ELSE '' END END AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, base ORDER BY ord) AS n FROM sheet)", base=False)
def mapped_sheet(spark, sf_dir):
    """The same sheet under other headers: its columns are found by their words, and its rows built."""
    names = {"start_x": "PICA 1 ESTE (E)", "start_y": "PICA 1 NORTE (N)", "end_x": "PICA 2 ESTE (E)", "end_y": "PICA 2 NORTE (N)", "block": "BLOQUE", "tracker": "TRACKER", "tracker_row": "MOTOR ROW", "side": "LADO"}
    raw = sheet(spark, sf_dir).withColumnsRenamed(names)
    return build_rows(H.renamed(raw, H.suggest_fields(raw.drop("ord").columns))).select("ord", "reason", "side", "row_id")


@query(BY_NAME + "SELECT o_orderkey AS ord, 'S-' || o_orderkey % 9 || '.' || o_orderkey AS label, block, CAST(CAST(tracker AS INT) AS VARCHAR) AS tracker_no, label_row, CASE WHEN o_orderkey % 3 = 0 THEN 'DC' || o_orderkey % 17 END AS dc_box FROM entries JOIN orders ON ord = o_orderkey WHERE o_orderkey % 4 > 0", base=False)
def string_entries(spark, sf_dir):
    """Entries of a list under its own headers; lines without a label go."""
    k = F.col("o_orderkey")
    raw = read(spark, sf_dir, "orders").select(
        k.alias("ord"), F.when(k % 4 == 0, "  ").otherwise(F.format_string(" S-%d.%d", k % 9, k)).alias("STRING"),
        F.concat_ws("-", (k % 50).cast("string"), F.lpad((F.floor(k / 50) % 40).cast("string"), 3, "0"), F.concat(F.lit("R"), (k % 4).cast("string"))).alias("TRACKER"), F.when(k % 3 == 0, F.concat(F.lit("DC"), (k % 17).cast("string"))).alias("DC BOX No."),
    )
    entries = S.read_entries(H.renamed(raw, H.suggest_string_fields(raw.drop("ord").columns)))
    return entries.select("ord", "label", "block", "tracker_no", "label_row", "dc_box")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '|' || (p_partkey + 1) WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS numbers FROM part", base=False)
def string_number_lists(spark, sf_dir):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_partkey || ' - ' || (p_partkey + 1) WHEN 1 THEN ' ' || p_partkey || ' ; x' ELSE 'none' END")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(numbers_in(text), lambda x: x.cast("long").cast("string")), "|").alias("numbers"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'A: ' || o_orderkey ELSE 'A: ' || o_orderkey || ' · B: ' || left(o_orderpriority || ' and more than that', 22) END AS text FROM orders""", base=False
)
def described_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    b = F.when(k % 5 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" and more than that")))
    return read(spark, sf_dir, "orders").select("o_orderkey", described(F.create_map(F.lit("A"), k.cast("string"), F.lit("B"), b, F.lit("C"), F.lit(None).cast("string"))).alias("text"))


@query(
    SHEET + ", g AS (SELECT reason, ord, row_number() OVER (PARTITION BY reason ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY reason) AS c FROM sheet WHERE reason IS NOT NULL) SELECT DISTINCT reason, ord, 'line: ' || ord AS text FROM g WHERE i = 0 OR i = c // 2 OR i = c - 1",
    base=False,
)
def skipped_samples(spark, sf_dir):
    rows = sheet(spark, sf_dir)
    cells = rows.select("ord", F.create_map(F.lit("line"), F.col("ord").cast("string")).alias("cells"))
    return skip_samples(skip_summary(build_rows(rows).where("reason IS NOT NULL")), cells)


@query("SELECT c_custkey, format('{:.3f}', c_custkey / 8.0) AS text FROM customer", base=False)
def fixed_decimals(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", fixed(F.col("c_custkey") / 8.0, 3).alias("text"))


# ---- string lists ---------------------------------------------------------------------------------------------------------
LABELLED = BY_NAME + ", named AS (SELECT m.row_id, m.ord, 'S-' || m.ord % 9 || '.' || m.ord AS label, CASE WHEN m.ord % 3 = 0 THEN 'DC' || m.ord % 17 END AS dc_box FROM matches m), by_row AS (SELECT row_id, list(label ORDER BY ord) AS labels, arg_max(dc_box, ord) FILTER (dc_box IS NOT NULL) AS dc_box FROM named GROUP BY row_id) "


def strings(spark, sf_dir):
    return S.strings_of_rows(match_entries_of(spark, sf_dir), matched(spark, sf_dir))


@query(LABELLED + "SELECT row_id, array_to_string(labels, ',') AS labels, dc_box FROM by_row", base=False)
def row_strings(spark, sf_dir):
    return strings(spark, sf_dir).select("row_id", F.array_join("labels", ",").alias("labels"), "dc_box")


@query(LABELLED + "SELECT r.row_id, b.dc_box FROM rows r JOIN by_row b USING (row_id) WHERE b.dc_box IS NOT NULL", base=False)
def rows_with_box(spark, sf_dir):
    return S.rows_with_box(match_rows_of(spark, sf_dir), strings(spark, sf_dir)).select("row_id", "dc_box")


@query(
    LABELLED + """, numbered AS (SELECT row_id, list(CAST(ord % 9 AS BIGINT) ORDER BY ord % 9, ord) AS numbers, list(label ORDER BY ord % 9, ord) AS labels FROM named GROUP BY row_id)
    SELECT r.row_id, array_to_string(n.numbers, ',') AS numbers, array_to_string(n.labels, ',') AS labels, CAST(CASE WHEN r.row_ord % 2 = 0 THEN r.row_ord % 3 + 1 WHEN r.row_ord % 3 = 0 THEN 7 END AS DOUBLE) AS pos FROM rows r LEFT JOIN numbered n USING (row_id)""",
    base=False,
)
def apply_strings(spark, sf_dir):
    rows = match_rows_of(spark, sf_dir).withColumn("pos", F.when(F.col("row_ord") % 3 == 0, 7.0))
    chains = rows.where("row_ord % 2 = 0").select("row_id", (F.col("row_ord") % 3 + 1).alias("pos"), F.lit(3).alias("pos_total"))
    out = S.apply_strings(rows, strings(spark, sf_dir), chains, 0)
    return out.select("row_id", F.array_join(F.transform("string_numbers", lambda x: x.cast("long").cast("string")), ",").alias("numbers"), F.array_join("string_labels", ",").alias("labels"), "pos")


REPORT = """, tied AS (SELECT e.*, m.row_id, e.block || '-' || lpad(e.tracker, 3, '0') || ' R' || substr(e.label_row, 2) AS name, 'S-' || e.ord % 9 || '.' || e.ord AS label FROM entries e LEFT JOIN matches m USING (ord)),
    paired AS (SELECT block || '-' || tracker || ': ' || string_agg(label_row || ' → ' || coalesce(geometry_row, '?'), ', ' ORDER BY i) AS text, min(row_ord) AS seen FROM pairs WHERE n > 1 GROUP BY block, tracker)
    SELECT CAST(coalesce((SELECT max(tier) FROM matches), 1) AS INT) AS tier, count(row_id) AS matched, count(*) AS total, count(DISTINCT row_id) AS rows_with_strings, CAST(floor(count(DISTINCT row_id) * 100 / (SELECT count(*) FROM rows) + 0.5) AS INT) AS coverage,
    count(DISTINCT row_id) < 0.9 * (SELECT count(*) FROM rows) AS low, (SELECT string_agg(name || ' → ' || label, '; ' ORDER BY ord) FROM (SELECT * FROM tied WHERE row_id IS NULL ORDER BY ord LIMIT 6)) AS unmatched,
    (SELECT string_agg(name || ' = ' || block || ' · ' || tracker || ' · ' || label_row, '; ' ORDER BY ord) FROM (SELECT * FROM tied ORDER BY ord LIMIT 3)) AS shown,
    (SELECT string_agg(text, '; ' ORDER BY seen) FROM (SELECT * FROM paired WHERE (SELECT max(tier) FROM matches) = 5 ORDER BY seen LIMIT 4)) AS pairs FROM tied"""


def _report(spark, sf_dir, by_order):
    out = S.match_report(match_entries_of(spark, sf_dir, by_order), match_rows_of(spark, sf_dir, by_order), matched(spark, sf_dir, by_order))
    text = lambda c: F.array_join(c, "; ").alias(c)
    return out.select("tier", "matched", "total", "rows_with_strings", "coverage", "low", F.nullif(F.array_join("unmatched", "; "), F.lit("")).alias("unmatched"), text("shown"), text("pairs"))


@query(BY_NAME + REPORT, base=False)
def match_report(spark, sf_dir):
    return _report(spark, sf_dir, False)


@query(BY_ORDER_SQL + REPORT, base=False)
def match_report_by_order(spark, sf_dir):
    return _report(spark, sf_dir, True)


@query(
    "SELECT field, count(DISTINCT n) AS n_distinct, array_to_string(list_slice(list_sort(list(DISTINCT n)), 1, 6), ',') AS smallest FROM (SELECT 0 AS field, CAST(o_orderkey % 9 AS BIGINT) AS n FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500) UNION ALL SELECT 1, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500)) GROUP BY field",
    base=False,
)
def label_profile(spark, sf_dir):
    out = S.label_fields(match_entries_of(spark, sf_dir))
    return out.select("field", F.col("n_distinct").cast("long").alias("n_distinct"), F.array_join(F.transform("smallest", lambda x: x.cast("long").cast("string")), ",").alias("smallest"))


# ---- sides and chains -----------------------------------------------------------------------------------------------------
def placed_rows(spark, sf_dir):
    """Blocks of rows by key: two sides of a road, one side, two groups too close for a road, and lone rows; some stakes are swapped."""
    k = F.col("p_partkey")
    block, i = F.floor(k / 24), k % 24
    shape = block % 4
    rise = F.when(shape == 0, F.when(i < 12, 0.00066).otherwise(0.0)).when(shape == 1, 0.0).when(shape == 2, F.when(i < 5, 0.0004).otherwise(0.0)).otherwise(i * 0.00062)
    low = F.lit(-27.4) + block * 0.01 + rise + (i % 3) * 0.000005
    high = low + 0.00058 + (i % 5) * 0.000001
    lon = F.lit(152.7) + (i % 12) * 0.00006
    swap = k % 2 == 0
    name = F.when(shape == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise(block.cast("string"))
    return read(spark, sf_dir, "part").select(
        k.alias("row_ord"), F.concat(F.lit("p"), k.cast("string")).alias("row_id"), name.alias("block"), F.when(k % 10 > 0, F.concat(F.lit("box"), block.cast("string"))).alias("dc_box"),
        F.when(swap, high).otherwise(low).alias("lat_a"), lon.alias("lon_a"), F.when(swap, low).otherwise(high).alias("lat_b"), lon.alias("lon_b"), F.when(k % 9 == 0, "east").alias("side"),
    )


def _placed_sql(key: str, where: str = "true") -> str:
    from .driver import A, E2

    d = "CAST({} AS DOUBLE)".format
    return f"""WITH keyed AS (SELECT p_partkey AS k, p_partkey // 24 AS b, p_partkey % 24 AS i FROM part),
    shaped AS (SELECT *, {d(-27.4)} + b * {d(0.01)} + CASE b % 4 WHEN 0 THEN CASE WHEN i < 12 THEN {d(0.00066)} ELSE {d(0)} END WHEN 1 THEN {d(0)} WHEN 2 THEN CASE WHEN i < 5 THEN {d(0.0004)} ELSE {d(0)} END ELSE i * {d(0.00062)} END + (i % 3) * {d(0.000005)} AS low FROM keyed),
    ends AS (SELECT *, low + {d(0.00058)} + (i % 5) * {d(0.000001)} AS high, {d(152.7)} + (i % 12) * {d(0.00006)} AS lon, CASE WHEN b % 4 = 3 THEN 'x' || k ELSE CAST(b AS VARCHAR) END AS block, CASE WHEN k % 10 > 0 THEN 'box' || b END AS dc_box FROM shaped),
    anchored AS (SELECT *, first_value(CASE WHEN k % 2 = 0 THEN high ELSE low END) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM ends WHERE {where} WINDOW w AS (PARTITION BY {key} ORDER BY k)),
    scaled AS (SELECT *, {A} / sqrt(1 - {E2} * power(sin(radians(lat0)), 2)) * cos(radians(lat0)) AS east, {A * (1 - E2)} / power(1 - {E2} * power(sin(radians(lat0)), 2), 1.5) AS north FROM anchored),
    placed AS (SELECT *, radians((low + high) / 2 - lat0) * north AS along, radians(high - low) * north AS length, -radians(lon - lon0) * east AS across FROM scaled)"""


@query(
    _placed_sql("block")
    + """, ranked AS (SELECT *, row_number() OVER w AS place, along - lag(along) OVER w AS step, count(*) OVER (PARTITION BY block) AS n, row_number() OVER (PARTITION BY block ORDER BY length) - 1 AS li FROM placed WINDOW w AS (PARTITION BY block ORDER BY along, k)),
    cuts AS (SELECT block, max(n) AS n, max(step) AS gap, min(CASE WHEN step = g THEN place END) AS at, max(CASE WHEN li = n // 2 THEN length END) AS median FROM (SELECT *, max(step) OVER (PARTITION BY block) AS g FROM ranked) GROUP BY block),
    parted AS (SELECT r.*, c.at, c.gap, c.median, place >= c.at AS upper FROM ranked r JOIN cuts c USING (block)),
    halves AS (SELECT block, upper, max(CASE WHEN i2 = m // 2 THEN length END) AS half FROM (SELECT *, row_number() OVER (PARTITION BY block, upper ORDER BY length) - 1 AS i2, count(*) OVER (PARTITION BY block, upper) AS m FROM parted) GROUP BY block, upper),
    facing AS (SELECT block, avg(half) AS facing FROM halves GROUP BY block),
    report AS (SELECT c.*, CASE WHEN c.n < 2 THEN 'ambiguo' WHEN NOT (gap > 0) OR gap < 0.5 * median THEN 'un-solo-lado' WHEN gap < 0.95 * facing THEN 'escalonado' ELSE 'dos-lados' END AS status FROM cuts c JOIN facing USING (block))
    SELECT block, n AS rows, status, CAST(round(gap * 100) AS BIGINT) AS gap_cm FROM report""",
    base=False,
)
def side_report(spark, sf_dir):
    report = D.side_report(placed_rows(spark, sf_dir))[1]
    return report.select("block", "rows", "status", F.round(F.col("gap") * 100).cast("long").alias("gap_cm"))


@query(
    "SELECT 'p' || p_partkey AS row_id, CASE WHEN p_partkey // 24 % 4 = 0 AND (SELECT count(*) FROM part q WHERE q.p_partkey // 24 = p.p_partkey // 24) > 12 THEN CASE WHEN p_partkey % 24 < 12 THEN 'north' ELSE 'south' END WHEN p_partkey % 9 = 0 THEN 'east' END AS side FROM part p",
    base=False,
)
def side_derivation(spark, sf_dir):
    """Rows of two-sided blocks get the derived side; others keep their own."""
    rows = placed_rows(spark, sf_dir)
    return D.with_sides(rows, D.side_report(rows)[0]).select("row_id", "side")


CHAINS = _placed_sql("dc_box", "dc_box IS NOT NULL") + """, boxes AS (SELECT dc_box, count(*) AS n, max(along) - min(along) AS a, max(across) - min(across) AS c, avg(length) AS mean FROM placed GROUP BY dc_box),
    shaped_boxes AS (SELECT *, CASE WHEN n = 1 OR (a > 0.5 * mean AND a > c) THEN 'cadena' WHEN c > a THEN 'paralelas' ELSE 'mixta' END AS shape FROM boxes)"""


@query(CHAINS + " SELECT dc_box, n AS rows, shape, CAST(round(a * 1000) AS BIGINT) AS along_mm, CAST(round(c * 1000) AS BIGINT) AS across_mm FROM shaped_boxes", base=False)
def chain_report(spark, sf_dir):
    return D.chain_report(placed_rows(spark, sf_dir))[1].select("dc_box", "rows", "shape", mm(F.col("along_m")).alias("along_mm"), mm(F.col("across_m")).alias("across_mm"))


@query(
    CHAINS + " SELECT 'p' || k AS row_id, CAST(CASE WHEN shape = 'cadena' THEN row_number() OVER (PARTITION BY dc_box ORDER BY along, k) ELSE 1 END AS INT) AS pos, CAST(CASE WHEN shape = 'cadena' THEN n ELSE 1 END AS INT) AS pos_total FROM placed JOIN shaped_boxes USING (dc_box) WHERE shape <> 'mixta'",
    base=False,
)
def chain_derivation(spark, sf_dir):
    return D.chain_report(placed_rows(spark, sf_dir))[0]


@query(CHAINS + " SELECT count(*) FILTER (shape = 'cadena') AS cadena, count(*) FILTER (shape = 'paralelas') AS paralelas, count(*) FILTER (shape = 'mixta') AS mixta FROM shaped_boxes", base=False)
def chain_shapes(spark, sf_dir):
    return S.chain_shapes(D.chain_report(placed_rows(spark, sf_dir))[1])


# ---- merges ---------------------------------------------------------------------------------------------------------------
def versions(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(s.alias("row_ord"), s.cast("string").alias("row_id"), (F.lit(-27.4) + s * 0.0001).alias("lat_a"), F.lit(152.7).alias("lon_a"), s.alias("k"))
    moved = rows.where("k % 3 = 0").withColumn("lat_a", F.col("lat_a") + F.when(F.col("k") % 2 == 0, 0.0001 * (F.col("k") % 10)).otherwise(0.0))
    return rows.where("k % 4 <> 1"), moved


@query("SELECT count(*) FILTER (s_suppkey % 4 = 1) AS new, count(*) FILTER (s_suppkey % 4 <> 1) AS repeated FROM supplier WHERE s_suppkey % 3 = 0", base=False)
def merge_counts(spark, sf_dir):
    return M.merge_counts(*versions(spark, sf_dir))


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS row_id, CAST(round(d * 1000) AS BIGINT) AS apart_mm FROM (SELECT s_suppkey, radians(0.0001 * (s_suppkey % 10)) * (6378137.0 * (1 - e2) / power(1 - e2 * power(sin(radians(CAST(-27.4 AS DOUBLE))), 2), 1.5)) AS d FROM supplier, (SELECT CAST(0.0066943799901413165 AS DOUBLE) AS e2) WHERE s_suppkey % 6 = 0 AND s_suppkey % 4 <> 1) WHERE d > 50",
    base=False,
)
def merge_collisions(spark, sf_dir):
    return M.collisions(*versions(spark, sf_dir), lat0=-27.4).select("row_id", mm(F.col("distance")).alias("apart_mm"))


@query("SELECT o_orderkey, o_orderstatus AS outcome, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS counted FROM orders", base=False)
def appended_checks(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "outcome")
    return M.appended(o.where("o_orderkey % 2 = 0").select("o_orderkey", "outcome"), o.where("o_orderkey % 2 = 1").select("o_orderkey", "outcome", F.col("o_custkey").alias("counted")))


@query(
    """SELECT p_brand, n, CAST(round(median * 1000) AS BIGINT) AS median_mm, CAST(round((p90 - p10) * 1000) AS BIGINT) AS spread_mm, CAST(round((median - (2 * (14 * 2.02 - 0.02) + 1)) * 500) AS BIGINT) AS offset_mm, abs((median - (2 * (14 * 2.02 - 0.02) + 1)) * 500 + 400) > 50 AS suggest, (p90 - p10) * 1000 > 500 AS uneven
    FROM (SELECT p_brand, count(*) AS n, max(CASE WHEN i = floor(c * 0.1) THEN v END) AS p10, max(CASE WHEN i = floor(c * 0.5) THEN v END) AS median, max(CASE WHEN i = floor(c * 0.9) THEN v END) AS p90
    FROM (SELECT *, 56 + p_partkey % 997 / 700.0 AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 997) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS c FROM part) GROUP BY p_brand)""",
    base=False,
)
def offset_advice(spark, sf_dir):
    lengths = read(spark, sf_dir, "part").select("p_brand", (56 + F.col("p_partkey") % 997 / 700.0).alias("length"))
    out = M.offset_advice(lengths, Layout(14, 2, 2.0, 0.02, 1.0, 0.0), "p_brand", stated_mm=-400.0)
    return out.select("p_brand", "n", mm(F.col("median")).alias("median_mm"), F.round("spread_mm").cast("long").alias("spread_mm"), F.round("offset_mm").cast("long").alias("offset_mm"), "suggest", "uneven")


# ---- findings -------------------------------------------------------------------------------------------------------------
def photos(spark, sf_dir):
    k = F.col("fix_id")
    return slanted_fixes(spark, sf_dir).withColumns({"file_name": F.concat(F.lit("DJI"), F.when(k % 50 == 0, ",").otherwise("_"), k.cast("string"), F.lit(".JPG")), "taken_at": F.when(k % 2 == 0, "2024-05-01T10:00:00Z")})


def findings(spark, sf_dir):
    return R.findings(photos(spark, sf_dir), located(spark, sf_dir), slanted_rows(spark, sf_dir))


def reviewed(spark, sf_dir):
    k = F.col("fix_id")
    found = findings(spark, sf_dir).withColumns({"klass": F.lit(None).cast("int"), "delta_t": F.lit(None).cast("double"), "module_fixed": F.lit(None).cast("int"), "anomaly": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})
    edits = read(spark, sf_dir, "events").select(F.col("event_id").alias("fix_id")).select(
        "fix_id", F.when(k % 3 == 1, "confirmado").when(k % 3 == 2, "descartado").otherwise("pendiente").alias("status"), F.when(k % 4 > 0, (k % 4).cast("int")).alias("klass"), (k % 7 * 1.5).alias("delta_t"),
        F.when(k % 5 == 0, 3).alias("module_fixed"), F.when(k % 8 == 0, "PID").otherwise("").alias("anomaly"), F.when(k % 6 == 0, 'a "b"').alias("note"),
    )
    return R.reviewed(found, edits)


FOUND = LOCATED + """, codes_of AS (SELECT fix_id, concat_ws(' ', nullif(max(CASE WHEN row_rank = 1 THEN replace(rules, ',', ' ') END), ''), CASE WHEN bool_or(row_rank = 1 AND in_gap) THEN 'in-string-gap' END, CASE WHEN bool_or(row_rank = 1 AND (raw < 1 OR raw > 28)) THEN 'outside-row-extent' END,
    CASE WHEN max(top) < 0.35 THEN 'low-confidence' END, CASE WHEN bool_or(rank > 1 AND confidence > 0.6 * top AND (row_id <> top_row OR string_number <> top_string)) THEN 'ambiguous' END) AS codes
    FROM (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER w AS top, max(CASE WHEN rank = 1 THEN row_id END) OVER w AS top_row, max(CASE WHEN rank = 1 THEN string_number END) OVER w AS top_string FROM found WINDOW w AS (PARTITION BY fix_id)) GROUP BY fix_id),
findings AS (SELECT f.fix_id, f.lat, f.lon, CASE f.fix_id % 3 WHEN 0 THEN '2.5' WHEN 1 THEN '0' ELSE '' END AS accuracy, 'DJI' || CASE WHEN f.fix_id % 50 = 0 THEN ',' ELSE '_' END || f.fix_id || '.JPG' AS file_name, b.k AS k, b.row_id, b.string_number, b.module, b.inverted, b.confidence,
    CASE f.fix_id % 3 WHEN 1 THEN 'confirmado' WHEN 2 THEN 'descartado' ELSE 'pendiente' END AS status, nullif(f.fix_id % 4, 0) AS klass, nullif(f.fix_id % 7 * 1.5, 0) AS delta_t, CASE WHEN f.fix_id % 5 = 0 THEN 3 END AS module_fixed,
    CASE WHEN f.fix_id % 8 = 0 THEN 'PID' END AS anomaly, CASE WHEN f.fix_id % 6 = 0 THEN 'a "b"' END AS note, coalesce(c.codes, 'no-row-within-range') AS codes
    FROM fixes f LEFT JOIN (SELECT * FROM found WHERE rank = 1) b USING (fix_id) LEFT JOIN codes_of c USING (fix_id)) """


@query(
    FOUND + """SELECT fix_id, concat_ws(',', CASE WHEN file_name LIKE '%,%' THEN '"' || file_name || '"' ELSE file_name END, CASE WHEN fix_id % 2 = 0 THEN '2024-05-01T10:00:00Z' ELSE '' END, format('{:.7f}', lat), format('{:.7f}', lon), accuracy,
    coalesce(CAST(k // 40 AS VARCHAR), ''), coalesce(CAST(k % 40 AS VARCHAR), ''), CASE WHEN k % 2 = 0 THEN 'R1' ELSE '' END, coalesce(CAST(CAST(string_number AS BIGINT) AS VARCHAR), ''), coalesce(CAST(module AS VARCHAR), ''),
    CASE WHEN inverted THEN 'punta lejana' WHEN NOT inverted THEN 'caja DC' ELSE '' END, coalesce(CAST(module_fixed AS VARCHAR), ''), coalesce(CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%', ''), coalesce(anomaly, ''), coalesce(CAST(klass AS VARCHAR), ''),
    coalesce(CASE WHEN delta_t = floor(delta_t) THEN CAST(CAST(delta_t AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', delta_t) END, ''), status, CASE WHEN note IS NULL THEN '' ELSE '"a ' || '""b""' || '"' END, codes) AS line FROM findings WHERE status <> 'descartado'""",
    base=False,
)
def findings_report(spark, sf_dir):
    """The report of a flight, all 19 columns of it."""
    return R.report_rows(reviewed(spark, sf_dir)).select("fix_id", "line")


@query(
    FOUND + "SELECT klass % 2 AS half, count(*) AS total, count(*) FILTER (status = 'pendiente') AS pending, count(*) FILTER (status = 'confirmado') AS confirmed, count(*) FILTER (status = 'descartado') AS discarded, count(*) FILTER (row_id IS NULL) AS unlocated, count(*) FILTER (klass = 1) AS class_1, count(*) FILTER (klass = 2) AS class_2, count(*) FILTER (klass = 3) AS class_3, count(DISTINCT k // 40) AS blocks FROM findings GROUP BY half",
    base=False,
)
def findings_summary(spark, sf_dir):
    return R.inspection_summary(reviewed(spark, sf_dir).withColumn("half", (F.col("klass") % 2).cast("long")), ("half",))


@query(FOUND + "SELECT fix_id, 'pendiente' AS which FROM findings WHERE status = 'pendiente' UNION ALL SELECT fix_id, 'sin-ubicar' FROM findings WHERE row_id IS NULL UNION ALL SELECT fix_id, 'todos' FROM findings", base=False)
def finding_views(spark, sf_dir):
    found, out = reviewed(spark, sf_dir).select("fix_id", "status", "address"), None
    for which in ("pendiente", "sin-ubicar", "todos"):
        one = R.view(found, which).select("fix_id", F.lit(which).alias("which"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    LOCATED + ", kept AS (SELECT * FROM found WHERE rank <= 8), tops AS (SELECT *, max(CASE WHEN rank = 1 THEN row_id END) OVER w AS top_row, max(CASE WHEN rank = 1 THEN string_number END) OVER w AS top_string FROM kept WINDOW w AS (PARTITION BY fix_id)) SELECT f.fix_id, n AS candidates, choices FROM fixes f LEFT JOIN (SELECT fix_id, count(*) AS n, string_agg(DISTINCT CASE WHEN row_id = top_row AND string_number = top_string THEN lpad(CAST(module AS VARCHAR), 2, '0') END, ',' ORDER BY CASE WHEN row_id = top_row AND string_number = top_string THEN lpad(CAST(module AS VARCHAR), 2, '0') END) AS choices FROM tops GROUP BY fix_id) USING (fix_id)",
    base=False,
)
def finding_candidates(spark, sf_dir):
    found = findings(spark, sf_dir)
    choices = F.transform(R.correction_choices(F.col("candidates"), F.col("address")), lambda m: F.lpad(m.cast("string"), 2, "0"))
    return found.select("fix_id", F.nullif(F.size("candidates").cast("long"), F.lit(0)).alias("candidates"), F.when(F.col("address").isNotNull(), F.array_join(choices, ",")).alias("choices"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'patched' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderpriority END AS priority FROM orders", base=False)
def patched_findings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    patches = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("patched").alias("status"), F.when(F.col("o_orderkey") % 10 == 0, "X").alias("priority"))
    return R.patched(o, patches, "o_orderkey")


DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"


@query(
    f"SELECT o_orderkey, ltrim(substr({DIGITS}, CAST(o_orderkey // 46656 % 36 + 1 AS INT), 1) || substr({DIGITS}, CAST(o_orderkey // 1296 % 36 + 1 AS INT), 1) || substr({DIGITS}, CAST(o_orderkey // 36 % 36 + 1 AS INT), 1), '0') || substr({DIGITS}, CAST(o_orderkey % 36 + 1 AS INT), 1) || '-' || (o_orderkey * 2654435761) % 65535 AS id FROM orders",
    base=False,
)
def finding_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", R.finding_id(F.col("o_orderkey")).alias("id"))


@query(
    "SELECT klass, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS klass) LEFT JOIN (SELECT o_orderkey % 5 AS k FROM orders) ON k = klass GROUP BY klass", base=False
)
def findings_by_class(spark, sf_dir):
    """Every thermography class with its number of findings."""
    own = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("klass")).groupBy("klass").count()
    return F.broadcast(R.thermal_classes(spark)).join(own, "klass", "left").select("klass", F.coalesce("count", F.lit(0)).alias("n"))  # three classes


@query(
    "SELECT anomaly, place, count(k) AS n FROM (SELECT unnest(['Punto caliente', 'Celda multiple', 'Diodo de bypass', 'String completo', 'Modulo completo', 'PID', 'Suciedad', 'Sombra', 'Caja de conexion', 'Vidrio roto', 'Otro']) AS anomaly, unnest(range(1, 12)) AS place) LEFT JOIN (SELECT o_orderkey % 14 AS k FROM orders) ON k = place GROUP BY anomaly, place",
    base=False,
)
def findings_by_anomaly(spark, sf_dir):
    own = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 14).cast("int").alias("place")).groupBy("place").count()
    return F.broadcast(R.anomaly_kinds(spark)).join(own, "place", "left").select("anomaly", F.col("place").cast("long").alias("place"), F.coalesce("count", F.lit(0)).alias("n"))


# ---- checks, cards and profiles -------------------------------------------------------------------------------------------
def checks(spark, sf_dir):
    k = F.col("fix_id")
    best = located(spark, sf_dir).where("rank = 1").select("fix_id", "row_id", "string_number", "module", "counted_from")
    verdicts = read(spark, sf_dir, "events").select(F.col("event_id").alias("fix_id")).where("fix_id % 10 = 0").select(
        "fix_id", F.concat(F.lit("2024-05-0"), (k % 7 + 1).cast("string"), F.lit("T10:00:00Z")).alias("at"), F.when(k % 30 == 0, "mismatch").otherwise("match").alias("outcome"), F.when(k % 60 == 0, -1).otherwise(5).alias("counted"), F.lit(1.5).alias("accuracy"), F.when(k % 90 == 0, "seen").otherwise("").alias("note")
    )
    return R.check_records(best, verdicts, slanted_rows(spark, sf_dir))


@query(
    LOCATED + """SELECT '2024-05-0' || (fix_id % 7 + 1) || 'T10:00:00Z-' || row_id AS check_id, fix_id, row_id, CAST(k // 40 AS VARCHAR) AS block, string_number, module, CASE k % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' END AS side,
    CASE WHEN fix_id % 30 = 0 THEN 'mismatch' ELSE 'match' END AS outcome, CASE WHEN fix_id % 30 = 0 AND fix_id % 60 <> 0 THEN 5 END AS counted_module, CASE WHEN fix_id % 90 = 0 THEN 'seen' END AS note FROM found WHERE rank = 1 AND fix_id % 10 = 0""",
    base=False,
)
def check_records(spark, sf_dir):
    return checks(spark, sf_dir).select("check_id", "fix_id", "row_id", "block", "string_number", "module", "side", "outcome", "counted_module", "note")


@query(
    LOCATED + """, checks AS (SELECT 'Block ' || (k // 40) || ', tracker ' || (k % 40) || CASE WHEN k % 2 = 0 THEN ' R1' ELSE '' END || ', string ' || CAST(string_number AS BIGINT) || ', module ' || module || CASE WHEN inverted THEN ' (from the far end)' ELSE ' (from the DC box)' END AS said,
    '2024-05-0' || (fix_id % 7 + 1) AS day, '2024-05-0' || (fix_id % 7 + 1) || 'T10:00:00Z-' || row_id AS check_id, fix_id % 30 = 0 AS wrong, CASE WHEN fix_id % 60 <> 0 THEN '5' ELSE 'another' END AS counted, CASE WHEN fix_id % 90 = 0 THEN ': seen' ELSE '' END AS note, inverted, k % 4 AS side FROM found WHERE rank = 1 AND fix_id % 10 = 0),
    facts AS (SELECT count(*) FILTER (NOT wrong) AS matches, count(*) FILTER (wrong) AS mismatches, bool_or(NOT wrong AND NOT inverted) AS near_dc, bool_or(NOT wrong AND inverted) AS far_end, count(DISTINCT side) FILTER (NOT wrong AND side < 3) >= 2 AS sides,
    coalesce(string_agg(said || ' (' || day || ')', chr(10) ORDER BY day, check_id, said || ' (' || day || ')') FILTER (NOT wrong), '') AS verified, coalesce(string_agg('UNEXPLAINED: ' || said || ', counted ' || counted || ' (' || day || ')' || note, chr(10) ORDER BY day, check_id, 'UNEXPLAINED: ' || said || ', counted ' || counted || ' (' || day || ')' || note) FILTER (wrong), '') AS wrongs FROM checks)
    SELECT CASE WHEN matches = 0 THEN 'unverified' WHEN near_dc AND far_end AND sides AND mismatches = 0 THEN 'field-verified' ELSE 'partial' END AS status, verified,
    concat_ws(chr(10), nullif(wrongs, ''), CASE WHEN NOT near_dc THEN 'rule not covered: near_dc' END, CASE WHEN NOT far_end THEN 'rule not covered: far_end' END, CASE WHEN NOT sides THEN 'rule not covered: sides' END) AS unverified FROM facts""",
    base=False,
)
def calibration(spark, sf_dir):
    out = R.calibration(checks(spark, sf_dir), slanted_rows(spark, sf_dir))
    return out.select("status", F.array_join("verified", "\n").alias("verified"), F.array_join("unverified", "\n").alias("unverified"))


@query(
    "SELECT p_brand AS farm_id, count(*) AS rows, count(DISTINCT p_size) AS blocks, CAST(floor(count(*) FILTER (p_partkey % 3 > 0) * 100 / count(*) + 0.5) AS INT) AS strings_percent, CAST(floor(count(*) FILTER (p_partkey % 4 > 0) * 100 / count(*) + 0.5) AS INT) AS chain_percent FROM part GROUP BY p_brand",
    base=False,
)
def farm_card(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("farm_id"), F.col("p_size").alias("block"), F.when(k % 3 > 0, F.array(F.lit(1.0))).alias("string_numbers"), F.when(k % 4 > 0, 1).alias("pos"), F.lit(2).alias("pos_total"))
    return R.farm_cards(rows)


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || s_suppkey ELSE 'planta-' || s_suppkey END AS farm_id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN s_suppkey % 5 + 1 ELSE 1 END AS version, CASE WHEN s_suppkey % 4 = 0 THEN 'partial' ELSE 'unverified' END AS calibration FROM supplier""",
    base=False,
)
def profile_versions(spark, sf_dir):
    k = F.col("s_suppkey")
    farms = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("farm_id"), F.concat(F.lit("Planta "), k.cast("string")).alias("name"))
    existing = farms.where("s_suppkey % 4 = 0").select("farm_id", (k % 5).cast("int").alias("profileVersion"), F.lit("partial").alias("calibration"))
    return P.next_version(farms, existing).select("s_suppkey", "farm_id", F.col("profileVersion").cast("long").alias("version"), "calibration")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'nominal' WHEN 1 THEN 'derive' ELSE 'explicit' END AS mode, CAST(CASE WHEN p_partkey % 3 = 2 THEN p_partkey END AS DOUBLE) AS mm FROM part", base=False)
def pitch_modes(spark, sf_dir):
    k = F.col("p_partkey")
    stated = F.when(k % 3 == 1, "derive").when(k % 3 == 2, k.cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", P.pitch_of(stated).alias("p")).select("p_partkey", "p.mode", "p.mm")


@query(
    "SELECT 's' || p_partkey AS row_id, preset, CASE WHEN preset = 'generico' THEN 'end' ELSE CASE p_partkey % 4 WHEN 0 THEN 'end' WHEN 1 THEN 'start' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'start' ELSE 'end' END ELSE 'start' END END AS origin_end, CASE WHEN preset = 'generico' THEN 28 ELSE 56 END AS modules FROM part, (SELECT unnest(['generico', 'pvh-28x2']) AS preset) WHERE false UNION ALL "
    "SELECT 's' || p_partkey, 'generico', 'start', 28 FROM part UNION ALL SELECT 's' || p_partkey, 'pvh-28x2', CASE p_partkey % 4 WHEN 0 THEN 'end' WHEN 1 THEN 'start' WHEN 2 THEN 'start' ELSE 'start' END, 56 FROM part",
    base=False,
)
def preset_farms(spark, sf_dir):
    """Rows compiled under both presets: the origin end and the modules of a row."""
    from ..operators.compiled import compile_rows

    out = None
    for name, profile in P.PRESETS.items():
        farm = P.farm_of(profile, -27.4, 152.7)
        one = compile_rows(slanted_rows(spark, sf_dir), farm).select("row_id", F.lit(name).alias("preset"), "origin_end", F.lit(farm.layout.total).alias("modules"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 4", base=False)
def last_mismatches(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "mismatch").alias("outcome"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("check_id"))
    return R.last_mismatches(o).select("o_orderkey")


__all__ = ["ORACLES", "QUERIES"]


@query(
    CHAINS + ", sided AS (SELECT DISTINCT CAST(p_partkey // 24 AS VARCHAR) AS block FROM part WHERE p_partkey // 24 % 4 <> 3 UNION SELECT 'x' || p_partkey FROM part WHERE p_partkey // 24 % 4 = 3) "
    "SELECT 'sides' AS report, block AS name, CAST(row_number() OVER (ORDER BY block || ',') AS INT) AS place FROM sided UNION ALL SELECT 'chains', dc_box, CAST(row_number() OVER (ORDER BY dc_box || ',') AS INT) FROM shaped_boxes",
    base=False,
)
def reports_in_order(spark, sf_dir):
    """The reports of sides and chains with the place of each line."""
    rows = placed_rows(spark, sf_dir)
    sides, chains = T.by_text(D.side_report(rows)[1], "block"), T.by_text(D.chain_report(rows)[1], "dc_box")
    return sides.select(F.lit("sides").alias("report"), F.col("block").alias("name"), "place").unionByName(chains.select(F.lit("chains").alias("report"), F.col("dc_box").alias("name"), "place"))


@query(
    CHAINS + " SELECT dc_box, shape FROM shaped_boxes ORDER BY dc_box || ',' LIMIT 12",
    base=False,
)
def shown_chains(spark, sf_dir):
    """The chain reports that a screen shows: the first twelve in their order."""
    return R.shown(D.chain_report(placed_rows(spark, sf_dir))[1], "chain reports", F.concat("dc_box", F.lit(","))).select("dc_box", "shape")


@query(SHEET + " SELECT reason, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INT) AS place FROM (SELECT reason, count(*) AS n, min(ord) AS first FROM sheet WHERE reason IS NOT NULL GROUP BY reason)", base=False)
def skips_in_order(spark, sf_dir):
    """Groups of rejected lines, the largest first, equal ones by their first line."""
    summary = skip_summary(build_rows(sheet(spark, sf_dir)).where("reason IS NOT NULL"))
    return T.in_order(summary, F.floor(-F.log2("n")), F.desc("n"), "first").select("reason", "n", "place")
