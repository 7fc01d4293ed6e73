"""The field against brute force over label sequences, its spans, and scores on held-out, odd and empty tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from solaraddr.llm.toxicity import fold, marginals, toxicity

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int"


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(1)
    count = np.array([3, 1, 5, 0, 2])
    emission, pairs = rng.standard_normal(count.sum()), rng.standard_normal((2, 2))
    odds, _, _ = marginals(emission, count, pairs)
    at = 0
    for n in count:
        own, mass = emission[at : at + n], np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(own[i] * y for i, y in enumerate(labels)) + sum(pairs[a, b] for a, b in itertools.pairwise(labels)))
            for i, y in enumerate(labels):
                mass[i, y] += weight
        assert odds[at : at + n] == pytest.approx(np.log(mass[:, 1] / mass[:, 0]) if n else [])
        at += n


def table(spark, n=240):
    texts = [(i, f"word{i % 17} some plain text word{i % 13} and more of it" + (f" you vile{i % 3} scum word{i % 5}" if i % 3 == 0 else ""), "own") for i in range(n)]
    labels = [(i, int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_held_out_texts_and_spans(spark):
    docs, labels = table(spark)
    extra = spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "çé you vile1 scum", ""), (902, "çé you vile1 scum", ""), (None, "plain text " * 30_000, "")], SCHEMA)
    repeated = labels.union(spark.createDataFrame([(0, 1), (0, 0), (None, 1), (5, None)], LABELS))
    rows = toxicity(docs.union(extra), repeated, fold()).withColumn("held", fold()).collect()
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 20 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) >= 0.95
    assert len(rows) == 245 and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[900].score == by_id[901].score < 0.5 and by_id[None].predicted == 0
    (span,) = by_id[902].spans
    assert "vile1 scum" in "çé you vile1 scum"[span.start : span.end]


@pytest.mark.parametrize("kept", ["toxic = 0", "toxic = 1", "toxic > 1"])
def test_labels_of_one_kind(spark, kept):
    docs, labels = table(spark, 40)
    rows = toxicity(docs, labels.where(kept), F.lit(False)).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark):
    docs, labels = table(spark, 10)
    assert toxicity(docs.where("doc_id < 0"), labels, fold()).count() == 0


def test_no_text_is_gathered_on_the_driver(spark, monkeypatch):
    docs, labels = table(spark, 40)
    gathered = []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): gathered.append(self.columns) or f(self))
    toxicity(docs, labels, F.lit(False))
    assert gathered and not any("text" in columns for columns in gathered)
