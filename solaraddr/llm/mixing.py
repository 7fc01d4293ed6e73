"""Mixing sources to target weights by nested hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the document hash; each of LEVELS histograms refines LEVEL_BITS of them.
LEVEL_BITS, LEVELS = 12, 4
HASH_BITS = LEVEL_BITS * LEVELS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """48 bits of an MD5: the same on every run and in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """(source, source_size) -> the same with `target` double.

    Sources in code-point order, null last, take the weights in turn and share all words. A target stops at `limit` times its
    source's size. Sources that stop are a prefix in the order of limit * size / weight, so running sums settle the resharing.
    One row a source: the only global ordering here is over that list.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn % len(weights) + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        totals.withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * limit)
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_stops", F.col("_cap") * F.col("_weights") <= (F.col("_all") - F.col("_capped")) * F.col("_w"))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))).over(every), F.lit(0)))
        .withColumn("_share", F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(every))
        .withColumn("target", F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_left").cast("double") * F.col("_w") / F.col("_share")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """How often a mix to target weights takes each row of `docs` (doc_id, text, source; other columns are ignored).

    Returns doc_id, source, size, source_size, target, copies, taken = copies * size, for every row. A source is repeated whole
    floor(target / size) times; of the rest, the documents whose hash lies below the source's threshold are taken once more.
    The threshold is found by histograms: words by source and by the top 12 bits of the hash, then by the next 12 within the
    boundary bucket alone, four times; no documents are sorted and none leave the executors. The last boundary bucket is taken
    if that comes nearer to the target.

    Nulls: a null text has size 0; null sources are one source, the last; null ids hash as the empty text. Rows with equal ids
    are taken or left together. An empty table gives no rows. Sources without words have target 0.
    """
    sized = _sized(docs)
    return (
        sized.join(small(mix_plan(sized, weights, limit)), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", F.col("whole") + (F.col("h") < F.col("cut")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """The rows of `docs` that the mix takes, all columns and `copies` (one of that name is replaced): the thresholds are applied to the documents as they are read."""
    plan = small(mix_plan(_sized(docs), weights, limit)).select("_s", "whole", "cut")
    own = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("_row"))
    taken = own.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.col("whole") + (doc_hash(F.col("doc_id")) < F.col("cut")).cast("long"))
    return taken.where("copies > 0").select("_row.*", "copies")


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "mix-sizes")


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """For each source (_s): source_size, target, whole repeats, and the hash below which documents are taken once more (cut)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(
        source_targets(totals, weights, limit)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    edge = small(plan).select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("acc"))
    for level in range(1, LEVELS + 1):
        shift, above = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
        e = edge.select(F.col("source").alias("_s"), "rest", "prefix", "acc")
        inside = sized.join(e if level > 1 else small(e), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", above) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("acc").alias("acc"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = (
            hist.withColumn("upto", F.col("acc") + run)
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "words", "rest")).alias("b"))
            .select("source", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("acc"), F.col("b.upto").alias("upto"))
        )
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("acc")
    cut = edge.select(F.col("source").alias("_s"), (F.col("prefix") + nearer.cast("long")).alias("cut"))
    return written(
        plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")),
        "mix-cuts",
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
summed AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM weighed),
stops AS (SELECT *, cap * weights <= (total - capped) * w AS stop FROM summed),
shares AS (SELECT *, total - coalesce(sum(CASE WHEN stop THEN cap END) OVER (), 0) AS spare,
    sum(CASE WHEN NOT stop THEN w END) OVER () AS share FROM stops),
targets AS (SELECT source, source_size,
    CASE WHEN stop THEN CAST(cap AS DOUBLE) ELSE CAST(spare AS DOUBLE) * CAST(w AS DOUBLE) / CAST(share AS DOUBLE) END AS target FROM shares),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM plan),
buckets AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, h),
runs AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM buckets),
edges AS (SELECT r.source, arg_min(r.h, r.h) AS h, arg_min(r.upto, r.h) AS upto, arg_min(r.words, r.h) AS words, any_value(p.rest) AS rest
  FROM runs r JOIN rests p ON r.source IS NOT DISTINCT FROM p.source WHERE r.upto > p.rest GROUP BY r.source),
cuts AS (SELECT source, h + CASE WHEN upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS cut FROM edges),
mixed AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
    CAST(p.whole + CASE WHEN s.h < coalesce(c.cut, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM sized s JOIN rests p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)
"""

OP1_SQL = MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"


def op1(spark, sf_dir: str) -> DataFrame:
    from .tables import load

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
