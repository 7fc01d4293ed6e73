"""Spreadsheet and geometry operators: fill, match, merge, chains, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Line numbers that one task fills or ranks, and metres of an axis that one task ranks.
LINES, METRES = 65536, 64.0


def ranked(df: DataFrame, key: str, bucket: Column, *order: str | Column, name: str = "_i") -> DataFrame:
    """Adds the place of each row within `key`, from 1, and `_total`, the key's rows. `bucket` has to rise with the order.

    Rows are numbered inside their bucket, and buckets by their counts: no key is sorted in one task, however many rows it has.
    """
    rows = df.withColumn("_bucket", bucket)
    own = Window.partitionBy(key)
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_before": F.sum("_n").over(own.orderBy("_bucket")) - F.col("_n"), "_total": F.sum("_n").over(own)}).drop("_n")
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    out = rows.withColumn(name, place).join(counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), "_before", "_total"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_bucket", "_key", "_b", "_before")


def forward_fill(df: DataFrame, column: str, key: str, order: str) -> DataFrame:
    """Empty cells take the last filled one above, in the order of the line numbers `order` (unique within `key`).

    Filled inside buckets of LINES lines; what a bucket begins with comes from the last filled cell of the buckets above it.
    """
    rows = df.withColumns({"_filled": F.nullif(F.trim(column), F.lit("")), "_bucket": F.floor(F.col(order) / LINES)})
    last = rows.groupBy(key, "_bucket").agg(F.max_by("_filled", F.when(F.col("_filled").isNotNull(), F.col(order))).alias("_last"))
    above = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.last("_last", ignorenulls=True).over(above).alias("_above"))
    inside = F.last("_filled", ignorenulls=True).over(Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_inside", inside).join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn(column, F.coalesce("_inside", "_above")).drop("_filled", "_bucket", "_inside", "_key", "_b", "_above")


def merge_rows(previous: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Previous rows that are not supplied again, and all incoming ones."""
    kept = previous.join(incoming.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("kept"))
    return kept.unionByName(incoming.withColumn("origin", F.lit("incoming")))


def number_repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """The n-th row of a repeated key gets the suffix #n, from the second on. `order` has to be unique within a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("unique_id", F.when(n > 1, F.concat(F.col(key).cast("string"), F.lit("#"), n.cast("string"))).otherwise(F.col(key).cast("string")))


def unique_matches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows whose key names exactly one right row."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(once, key)


def order_statistics(df: DataFrame, key: str, value: str, width: float = 1.0) -> DataFrame:
    """Upper median and floor-index tenth and ninetieth parts for each key.

    Equal values are counted first. Counts by buckets of `width` tell which bucket holds each of them; only values of those buckets are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).withColumn("_bucket", F.floor(F.col("_v") / width))
    own = Window.partitionBy(key)
    counts = rows.groupBy(key, "_bucket").agg(F.sum("_c").alias("_n"))
    counts = counts.withColumns({"n": F.sum("_n").over(own), "_before": F.sum("_n").over(own.orderBy("_bucket")) - F.col("_n")})
    wanted = counts.select("*", F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.lit(s).alias("share")) for x, s in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))])))
    wanted = wanted.withColumn("_place", F.floor(F.col("n") * F.col("share")) - F.col("_before")).where((F.col("_place") >= 0) & (F.col("_place") < F.col("_n"))).select(key, "_bucket", "n", "name", "_place")
    some = rows.join(wanted.select(key, "_bucket").distinct(), [key, "_bucket"])
    placed = some.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key, "_bucket").orderBy("_v")))
    found = placed.join(wanted, [key, "_bucket"]).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_c")))
    return found.groupBy(key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == x, F.col("_v"))).alias(x) for x in ("p10", "median", "p90")])


def chain_positions(df: DataFrame, box: str, along: Column, order: str) -> DataFrame:
    """Place of each row in its chain along the common axis, from 1 in the south, and the chain's size."""
    out = ranked(df.withColumn("_t", along), box, F.floor(F.col("_t") / METRES), "_t", order, name="pos")
    return out.withColumn("pos_total", F.col("_total").cast("int")).drop("_t", "_total")


def largest_gap(df: DataFrame, key: str, along: Column, order: str) -> DataFrame:
    """The widest step between neighbours on an axis, and the place after which it comes (the first of equal ones).

    Steps inside buckets of METRES, and those from one bucket's last place to the next one's first.
    """
    rows = ranked(df.withColumn("_t", along), key, F.floor(F.col("_t") / METRES), "_t", order).withColumn("_cell", F.floor(F.col("_t") / METRES))
    inside = rows.withColumn("gap", F.col("_t") - F.lag("_t").over(Window.partitionBy(key, "_cell").orderBy("_i"))).select(key, "_i", "gap")
    edges = rows.groupBy(key, "_cell").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.min("_i").alias("_i"))
    between = edges.withColumn("gap", F.col("_low") - F.lag("_high").over(Window.partitionBy(key).orderBy("_cell"))).select(key, "_i", "gap")
    steps = inside.unionByName(between).where("gap IS NOT NULL")
    return steps.groupBy(key).agg(F.max("gap").alias("gap"), F.max_by("_i", F.struct("gap", -F.col("_i"))).alias("at")).withColumn("at", F.col("at") - 1)


def in_order(df: DataFrame, bucket: Column, *order: str | Column) -> DataFrame:
    """Adds `place`, from 1, in an order over all rows. `bucket` has to rise with the order (a prefix of a text, a number's range)."""
    return ranked(df.withColumn("_all", F.lit(0)), "_all", bucket, *order, name="place").drop("_all", "_total")


def by_text(df: DataFrame, key: str) -> DataFrame:
    """Adds `place` in the order of reports by group: by the key's text and a comma after it, byte by byte; no key comes last."""
    text = F.concat(F.col(key).cast("string"), F.lit(","))
    return in_order(df, F.coalesce(F.left(text, F.lit(3)), F.lit("\U0010ffff")), text.asc_nulls_last())


def by_locale(df: DataFrame, column: str) -> DataFrame:
    """Adds `place` in the order of names as people write them: accents and case count last. Equal names keep the bytes' order."""
    name = F.collate(F.col(column), "UNICODE")
    return in_order(df, F.collate(F.left(F.col(column), F.lit(1)), "UNICODE_CI_AI"), name.asc_nulls_first(), F.col(column))


def csv_cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",;\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
