"""Field checks: which rules they cover, and what they say about a farm. Profiles: what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_summary(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: total, matches, mismatches, rules covered (near_dc, far_end, sides) and status.

    checks: outcome, counted_from, side; rows: side. A farm with one side has nothing to prove about sides. An unexplained mismatch
    or a rule not covered makes the status partial; without any match it is unverified.
    """
    ok = F.col("outcome") == "match"
    side = F.nullif("side", F.lit(""))
    there = rows.select(F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("counted_from"), F.lit(None).cast("string").alias("side"), side.alias("row_side"))
    both = checks.select("outcome", "counted_from", "side", F.lit(None).cast("string").alias("row_side"), F.lit(1).alias("check")).unionByName(there, allowMissingColumns=True)
    both = both.agg(
        F.count("check").alias("total"),
        F.count_if(ok).alias("matches"),
        F.count_if(F.col("outcome") == "mismatch").alias("mismatches"),
        (F.count_if(ok & (F.col("counted_from") == "near-dc")) > 0).alias("near_dc"),
        (F.count_if(ok & (F.col("counted_from") == "far-end")) > 0).alias("far_end"),
        F.count_distinct(F.when(ok, side)).alias("seen"),
        F.count_distinct("row_side").alias("there"),
    )
    both = both.withColumn("sides", (F.col("there") < 2) | (F.col("seen") >= 2))
    whole = F.col("near_dc") & F.col("far_end") & F.col("sides") & (F.col("mismatches") == 0)
    return both.withColumn("status", F.when(F.col("matches") == 0, "unverified").when(whole, "field-verified").otherwise("partial")).drop("seen", "there")


def profile_issues(profiles: DataFrame) -> DataFrame:
    """Adds `issues` to farm profiles: the path of every field that is missing or out of its range, in a fixed order."""
    col, no = F.col, lambda c: F.coalesce(~c, F.lit(True))
    positive = lambda p: no(col(p) > 0)
    count = lambda p: no((col(p) > 0) & (col(p) == F.floor(p)))
    a, inv = col("addressing.originStrategy"), col("addressing.inversionStrategy")
    pitch = col("module.pitchMm").cast("string")
    utm = F.coalesce(col("crs.type") == "utm", F.lit(False))
    bad = {
        "id": no(F.trim("id") != ""),
        "name": no(F.trim("name") != ""),
        "profileVersion": count("profileVersion"),
        "module.widthMm": positive("module.widthMm"),
        "module.gapMm": no(col("module.gapMm") >= 0),
        "module.pitchMm": (pitch != "derive") & no(pitch.try_cast("double") > 0),
        "topology.modulesPerString": count("topology.modulesPerString"),
        "topology.stringsPerRow": count("topology.stringsPerRow"),
        "topology.stringGapMm": col("topology.stringGapMm") < 0,
        "geometry.endpointOffsetMm": col("geometry.endpointOffsetMm").isNull() | F.isnan("geometry.endpointOffsetMm"),
        "geometry.endpointOffsetMode": ~col("geometry.endpointOffsetMode").isin("both", "origin", "none", ""),
        "addressing.originStrategy": no(a.isin("fixed-end", "dc-box-end", "per-row-flag")),
        "addressing.inversionStrategy": no(inv.isin("none", "piercing-chain", "per-string-flag")),
        "addressing.fixedEnd": (a == "fixed-end") & no(col("addressing.fixedEnd").isin("north", "south", "east", "west")),
        "addressing.piercing-chain": (inv == "piercing-chain") & (col("topology.stringsPerRow") > 2),
        "crs.zone": utm & (count("crs.zone") | (col("crs.zone") > 60)),
        "crs.hemisphere": utm & no(col("crs.hemisphere").isin("N", "S")),
    }
    return profiles.withColumn("issues", F.filter(F.array(*[F.when(c, name) for name, c in bad.items()]), lambda x: x.isNotNull()))
