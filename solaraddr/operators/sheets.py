"""From spreadsheet rows to tracker rows, and reports on what came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import utm_to_wgs84
from ..functions.text import described, to_number

#: Line numbers that share a bucket when the middle of a group is looked for.
BUCKET_LINES = 65536
# Words for the sides of a road, in English and Spanish.
SIDES = {
    "n": "north", "north": "north", "norte": "north", "s": "south", "south": "south", "sur": "south",
    "e": "east", "east": "east", "este": "east", "o": "west", "w": "west", "west": "west", "oeste": "west",
}


# A column of only these words says whether a row has the motor.
FLAGS = {
    "yes": "motorizada", "si": "motorizada", "sí": "motorizada", "true": "motorizada", "y": "motorizada",
    "no": "esclava", "false": "esclava", "n": "esclava",
}


def flag_labels(sheet: DataFrame, column: str = "tracker_row") -> DataFrame:
    """Turns a column of yes and no into row labels, if its filled cells hold at most four words, all of them flags; else leaves it."""
    word = F.lower(F.trim(column))
    filled = F.when(F.col(column) != "", word)
    names = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    verdict = sheet.agg(((F.count_distinct(filled) <= 4) & F.coalesce(F.bool_and(filled.isin(*FLAGS)), F.lit(False))).alias("_flag"))
    keyed = sheet.withColumn("_one", F.lit(1)).join(F.broadcast(verdict.withColumn("_one", F.lit(1))), "_one")  # verdict has one row
    return keyed.withColumn(column, F.when(F.col("_flag"), F.coalesce(names[word], F.col(column))).otherwise(F.col(column))).drop("_one", "_flag")


def side_of(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair])
    return words[F.lower(F.trim(text))]


def string_numbers(text: Column) -> Column:
    """Numbers in a list such as 1, 2 / 3; null if there are none."""
    found = F.filter(F.transform(F.split(text, r"[,;/\s-]+"), to_number), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def build_rows(sheet: DataFrame, utm: tuple[int, bool] | None = None) -> DataFrame:
    """Tracker rows of a sheet (ord, start_x, start_y, end_x, end_y, block, tracker, tracker_row, side, all text but ord).

    Rejected rows have a `reason`, the first that holds: missing-coordinates, missing-block-or-tracker, same-point. Accepted ones
    have a `row_id`, numbered where it repeats, in the order of `ord`, which has to be unique. `utm` is (zone, whether south) for metres; else x is longitude and y latitude.
    """
    number = {c: to_number(F.col(c)) for c in ("start_x", "start_y", "end_x", "end_y")}
    rows = sheet.withColumns(number | {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("block", "tracker", "tracker_row")})

    def place(x, y):
        return utm_to_wgs84(x, y, F.lit(utm[0]), F.lit(utm[1])) if utm else (y, x)

    (lat_a, lon_a), (lat_b, lon_b) = place(F.col("start_x"), F.col("start_y")), place(F.col("end_x"), F.col("end_y"))
    rows = rows.withColumns({"lat_a": lat_a, "lon_a": lon_a, "lat_b": lat_b, "lon_b": lon_b, "side": side_of(F.col("side"))})
    missing = F.col("start_x").isNull() | F.col("start_y").isNull() | F.col("end_x").isNull() | F.col("end_y").isNull()
    reason = F.when(missing, "missing-coordinates").when((F.col("block") == "") | (F.col("tracker") == ""), "missing-block-or-tracker")
    reason = reason.when((F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b")), "same-point")
    rows = rows.withColumn("reason", reason).withColumn("base_id", F.concat_ws("-", *[F.nullif(F.col(c), F.lit("")) for c in ("block", "tracker", "tracker_row")]))
    # one pass: rejected rows are numbered apart, by their line, and their number is not used
    n = F.row_number().over(Window.partitionBy(F.when(F.col("reason").isNull(), F.col("base_id")), F.when(F.col("reason").isNotNull(), F.col("ord"))).orderBy("ord"))
    numbered = F.when(n > 1, F.concat("base_id", F.lit("#"), n.cast("string"))).otherwise(F.col("base_id"))
    return rows.withColumn("row_id", F.when(F.col("reason").isNull(), numbered)).drop("base_id")


def skip_summary(rejected: DataFrame) -> DataFrame:
    """For each reason of (ord, reason): count, first, middle (number floor(n / 2) from 0) and last line, and whether they are one block.

    The middle is found by counts of buckets of lines and ranks inside one bucket, so that no group is sorted in one task.
    """
    bucket = F.floor(F.col("ord") / BUCKET_LINES)
    counts = rejected.groupBy("reason", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    own = Window.partitionBy("reason")
    counts = counts.withColumn("total", F.sum("n").over(own)).withColumn("before", F.sum("n").over(own.orderBy("bucket")) - F.col("n"))
    half = F.floor(F.col("total") / 2)
    at = counts.where((F.col("before") <= half) & (half < F.col("before") + F.col("n"))).select("reason", "bucket", (half - F.col("before")).alias("place"))
    ranked = rejected.withColumn("bucket", bucket).join(at, ["reason", "bucket"]).withColumn("i", F.row_number().over(Window.partitionBy("reason", "bucket").orderBy("ord")) - 1)
    middle = ranked.where("i = place").select("reason", F.col("ord").alias("middle"))
    out = counts.groupBy("reason").agg(F.sum("n").alias("n"), F.min("low").alias("first"), F.max("high").alias("last")).join(middle, "reason")
    return out.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n"))


def skip_samples(summary: DataFrame, sheet: DataFrame) -> DataFrame:
    """For each reason of a summary the first, middle and last line, each once, and what their cells say: reason, ord, text.

    sheet: ord and cells, a map from header to text.
    """
    lines = summary.select("reason", F.explode(F.array_distinct(F.array("first", "middle", "last"))).alias("ord"))
    return lines.join(sheet.select("ord", described(F.col("cells")).alias("text")), "ord").select("reason", "ord", "text")


def capabilities(rows: DataFrame, needs_side: bool = True, needs_chain: bool = True) -> DataFrame:
    """What the rows (row_label, side, pos, pos_total, strings) allow: six lines of capability, share in percent, and whether it is there."""
    has = {"row-label": F.col("row_label") != "", "side": F.col("side").isNotNull(), "chain": F.col("pos").isNotNull() & F.col("pos_total").isNotNull(), "strings": F.size("strings") > 0}
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in has.items()])
    share = lambda k: F.floor(F.col(k) * 100 / F.greatest(F.col("rows"), F.lit(1)) + 0.5).cast("int")
    whole = lambda k: F.col(k) == F.col("rows")
    lines = [("position", share("rows"), F.col("rows") > 0), ("row-label", share("row-label"), F.col("row-label") > 0)]
    lines += [("origin-end", share("side"), whole("side") if needs_side else F.lit(True)), ("string-of-row", share("chain"), whole("chain") if needs_chain else F.lit(True))]
    lines += [("string-number", share("strings"), F.col("strings") > 0), ("serial", F.lit(0), F.lit(False))]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("capability"), p.alias("percent"), a.alias("available")) for k, p, a in lines])))


#: Rows whose coordinates tell what they are, and the zone that metres are taken to be in.
CRS_ROWS, ZONE = 40, 56


def guess_crs(places: DataFrame, zone: int = ZONE) -> DataFrame:
    """One row (crs, zone, hemisphere) from the first CRS_ROWS rows of (ord, x, y): wgs84 if all can be degrees or none is given, else utm.

    Metres lie in the south if their mean northing is over 5,000,000, which the false northing makes so. ord counts from 0.
    """
    x, y = F.col("x"), F.col("y")
    fine = places.where(F.col("ord") < CRS_ROWS).where(x.isNotNull() & y.isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    facts = fine.agg(F.coalesce(F.bool_and((F.abs(y) <= 90) & (F.abs(x) <= 180)), F.lit(True)).alias("_degrees"), F.avg(y).alias("_mean"))
    metres = ~F.col("_degrees")
    return facts.select(F.when(metres, "utm").otherwise("wgs84").alias("crs"), F.when(metres, zone).alias("zone"), F.when(metres, F.when(F.col("_mean") > 5_000_000, "S").otherwise("N")).alias("hemisphere"))
