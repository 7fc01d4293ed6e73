"""The corpus pipeline: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents, and the last adds `copies` (`copies_`
where documents have such a column). Other columns, whatever their names, are carried along. Repeated runs agree.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solaraddr.llm.jaccard import marked_groups, row_key
from solaraddr.llm.leaks import mark_leaks
from solaraddr.llm.mixing import mixed_documents
from solaraddr.llm.substrings import dedup_substrings
from solaraddr.llm.tables import load, written
from solaraddr.llm.toxicity import toxicity

#: The columns that stages read or write; others pass under names of their own, so that none can clash.
NAMED = ("doc_id", "text", "source", "n_chars")


def carrying(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shelter = {c: c if c in NAMED else f"extra{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in shelter.items()]), sf_dir)
        added = [c for c in out.columns if c not in shelter.values()]
        free = lambda c: c if c not in docs.columns else free(f"{c}_")
        return out.select(*[F.col(x).alias(c) for c, x in shelter.items()], *[F.col(c).alias(free(c)) for c in added])

    return run


@carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 0.5 or more go. It learns from every label."""
    scored = toxicity(docs, load(spark, sf_dir, "labels"), F.lit(False))
    return scored.where("predicted = 0").select(docs.columns)


@carrying
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 the document with the smallest id stays, once. Repeated rows are one document."""
    kept = marked_groups(docs.select("doc_id", "text"), size=5, percent=80).where("kept").select(F.col("doc").alias("_doc"), F.col("t").alias("_t")).distinct()
    doc, t = row_key()
    rows = docs.withColumns({"_doc": doc, "_t": t}).join(kept.hint("shuffle_hash"), ["_doc", "_t"], "left_semi")
    # of repeated rows the first by their other columns, as far as they can be ordered
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    once = F.row_number().over(Window.partitionBy("_doc", "_t").orderBy(*rest, F.col("text").isNull()))
    return rows.withColumn("_once", once).where("_once = 1").select(docs.columns)


@carrying
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that occur earlier go from the texts; n_chars follows."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = dedup_substrings(docs, keep=rest).withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


@carrying
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return mark_leaks(docs, load(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    return mixed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_similar), ("substring_dedup", cut_repeats), ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: The models and the similarity groups have no SQL; tests hold every stage against brute force or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
