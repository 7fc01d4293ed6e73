"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_ROWS, discard, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): each linked node and the smallest node of its component.

    Alternates large and small stars: every node hangs its larger neighbours, then its smaller ones and itself, on the smallest of
    them. The links never grow in number and become stars after logarithmically many rounds. Each round is a written table.

    A round over at most BROADCAST_ROWS links is one task: dealt out by key, it would be some six hundred for a few rows each.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = last = None
    while True:
        edges = written(edges, "links")
        if last is not None:
            discard(links.sparkSession, last)
        last = edges
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before, few = state, state[0] <= BROADCAST_ROWS
        both = edges.select("a", "b").union(edges.select("b", "a"))
        both = both.coalesce(1) if few else both
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        least = least.hint("shuffle_hash") if few else least
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least.hint("shuffle_hash") if few else least
        stars = large.join(least, "a").select("b", "m").union(least.select("a", "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = (stars.coalesce(1) if few else stars).distinct()
