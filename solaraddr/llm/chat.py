"""Chat formatting: collapse of cumulative snapshots, then rendering (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import load, written


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns numbered from 1 within each conversation in the order of turn (null last), role, text; exact repeats count once."""
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    w = Window.partitionBy("conv_id").orderBy(*order)
    same = F.lit(True)
    for c in ("turn", "role", "text"):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("_again", (F.row_number().over(w) > 1) & same)
        .where(~F.col("_again"))
        .withColumn("k", F.row_number().over(w).cast("long"))
        .select("conv_id", "k", "role", "text")
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one repeats or continues.

    Each turn is hashed with its number, and the running xor of these hashes (two of 64 bits) stands for the prefix up to it. A
    conversation goes if its last prefix is an inner prefix of another; of equal ones the smallest id stays (null first). Both
    sides of the anti-join hold each prefix once, so a first turn that a third of all conversations share is one row.
    """
    w = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    prefixes = written(
        _turns(conversations)
        .withColumn("p", F.bit_xor(F.xxhash64("k", role, text)).over(w))
        .withColumn("q", F.bit_xor(F.xxhash64(text, F.lit("turn"), role, "k")).over(w))
        .withColumn("last", F.lead("k").over(Window.partitionBy("conv_id").orderBy("k")).isNull())
        .select("conv_id", "k", "p", "q", "last"),
        "chat-prefixes",
    )
    inner = prefixes.where(~F.col("last")).select("k", "p", "q").distinct()
    ends = prefixes.where("last").groupBy("k", "p", "q").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id"))).alias("first"))
    return ends.join(inner, ["k", "p", "q"], "left_anti").select(F.col("first.conv_id").alias("conv_id"), F.col("k").alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Renders each maximal conversation: conv_id, n_turns, text with `<|im_start|>role`, the turn and `<|im_end|>` lines.

    Input: conv_id, turn, role, text; other columns are ignored. Rows without conv_id are one conversation. A null role or text
    equals an empty one. Of rows of one conversation that are equal in turn, role and text only one counts, also where turn is
    null: without numbers a turn that is said twice cannot be told from a row logged twice. A conversation becomes one row, so it has to fit a task; an empty table gives no rows.
    """
    kept = maximal_conversations(conversations).withColumnRenamed("conv_id", "_id")
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    return (
        _turns(conversations)
        .join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
        .groupBy("conv_id", "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct("k", turn.alias("t")))).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.col("turns.t"), "").alias("text"))
    )


OP10_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS k FROM rows),
marked AS (SELECT *, md5(role || chr(1) || text) AS m, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
prefixes AS (SELECT conv_id, k, n, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM marked),
ends AS (SELECT k AS n_turns, p, CASE WHEN bool_or(conv_id IS NULL) THEN NULL ELSE min(conv_id) END AS conv_id FROM prefixes WHERE k = n GROUP BY k, p),
kept AS (SELECT conv_id, n_turns FROM ends e WHERE NOT EXISTS (SELECT 1 FROM prefixes i WHERE i.k < i.n AND i.p = e.p))
SELECT t.conv_id, e.n_turns, string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.k) AS text
FROM turns t JOIN kept e ON t.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY t.conv_id, e.n_turns
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))
