"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import load, written
from .words import Words, chunks, mixed

#: Slots of the hashed features and of the evidence counts: the model has a fixed size.
SLOTS = 1 << 18
#: Labelled documents of each class that the field is fitted on (those with the smallest hashes); as many again fit the score. Counts of evidence use all.
FIT_DOCS = 300
#: Bytes of a text that the fit takes at most: longer ones are left to the counts of evidence, so that the sample stays small.
FIT_BYTES = 1 << 16
#: A word or word beginning is evidence if it is in so many toxic documents and such a share of them, and so many times likelier there.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.01, 12.0
STEPS = 30
#: Labels that teach, about (chosen by hash where there are more): a table of this size is broadcast, so that no text is shuffled.
LABEL_ROWS = 100_000


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    return mixed(h + np.uint64(kind))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(46)).astype(np.int32)


def _second_slot(keys: np.ndarray) -> np.ndarray:
    return _slot(mixed(keys))


def _print(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint32)


def features(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words (A-Z lower-cased) and their feature keys: the word without outer punctuation, its first 4, 5 and last 3 bytes."""
    words = Words(texts, lower=True)
    raw = words.start, words.end
    words.trim()
    start, end = words.start, words.end
    whole = words.hashes()
    length = end - start
    wide = words.buf.astype(np.uint64)

    def run(at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            there = (at + i >= start) & (at + i < end)
            h = (h << np.uint64(8)) | np.where(there, wide[np.clip(at + i, 0, len(wide) - 1)], 0).astype(np.uint64)
        return h

    keys = np.stack([_key(whole, 1), _key(run(start, 4) + (np.minimum(length, 5) << 40).astype(np.uint64), 2), _key(run(start, 5), 3), _key(run(end - 3, 3), 4)])
    words.start, words.end = raw
    return words, keys


def _evidence_counts(batches):
    """Documents of each class that hold a word or a beginning of 4 or 5 bytes, by slot.

    Each counts in two slots; it is evidence if both say so, which keeps strangers that share one slot out.
    """
    counts = np.zeros((2, SLOTS), np.int64)
    for pdf in batches:
        toxic = pdf["toxic"].to_numpy(np.int64)
        texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
        for begin, part in chunks(texts):
            words, keys = features(part)
            owner = words.owner().astype(np.int64)
            for row in (*_slot(keys[:3]), *_second_slot(keys[:3])):
                pair = np.unique(owner * SLOTS + row)
                for label in (0, 1):
                    mine = pair[toxic[begin + pair // SLOTS] == label] % SLOTS
                    counts[label] += np.bincount(mine, minlength=SLOTS)
    there = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"slot": there, "clean": counts[0][there], "toxic": counts[1][there]})


def evidence(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Which slots are evidence of toxicity, from every labelled text; and the share of toxic texts. Only such slots reach the driver."""
    docs = np.ones(2)
    for label, n in labelled.groupBy("toxic").count().collect():
        docs[label] = n
    # a slot of one document tells nothing of its class
    several = lambda c: F.when(F.col(c) >= 2, F.col(c)).otherwise(0).cast("double")
    counts = labelled.mapInPandas(_evidence_counts, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.select("slot", several("clean").alias("clean"), several("toxic").alias("toxic"))
    ratio = (F.col("toxic") / float(docs[1])) / ((F.col("clean") + 0.5) / float(docs[0]))
    found = counts.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * float(docs[1]))) & (ratio >= LEAST_RATIO)).select("slot").collect()
    signs = np.zeros(SLOTS, bool)
    signs[[r.slot for r in found]] = True
    return signs, docs[1] / docs.sum()


@dataclass
class Field:
    """Weights of the features for the toxic label, its bias, and log potentials of label pairs. Then the score's two weights and bias.

    prints: 32 more bits of the feature that owns each slot; another that falls there, unseen in the fit, has weight 0.
    """

    weights: np.ndarray
    prints: np.ndarray
    bias: float
    pairs: np.ndarray
    score: np.ndarray


def known(prints: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slots of features that the field was fitted on; SLOTS (weight 0) for others."""
    slots = _slot(keys)
    return np.where(prints[slots] == _print(keys), slots, SLOTS)


def marginals(emission: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: log odds of the toxic label for each token, and both messages.

    emission: log odds of each token alone, text after text; count: tokens of each text. Texts advance together, longest first,
    so a step costs a few numpy calls on the texts that still go on.
    """
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    length = count[order]
    forward, backward = emission.copy(), np.zeros_like(emission)
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t tokens
    t00, t01, t10, t11 = pairs.ravel()
    for t in range(1, longest):
        at = first[: active[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        b = emission[at] + backward[at]
        backward[at - 1] = np.logaddexp(t10, t11 + b) - np.logaddexp(t00, t01 + b)
    return forward + backward, forward, backward


def _odds(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_field(texts: list[bytes], toxic: np.ndarray, signs: np.ndarray, share: float) -> Field:
    """Fits the field by gradient ascent on tokens labelled by `signs` in toxic texts, then the score on every second text's label, weighed to `share` of toxic ones."""
    weights, prints, bias, pairs = np.zeros(SLOTS + 1), np.zeros(SLOTS, np.uint32), -4.0, np.array([[0.0, -1.0], [-1.0, 0.0]])
    sums_w, sums_p, sums_b = np.full(SLOTS + 1, 1e-8), np.full((2, 2), 1e-8), 1e-8
    n = len(texts)
    later = np.arange(n) % 2 == 1
    judged, judged_toxic = [texts[i] for i in np.flatnonzero(later)], toxic[later]
    texts, toxic = [texts[i] for i in np.flatnonzero(~later)], toxic[~later]
    if n < 4:
        return Field(weights, prints, bias, pairs, np.array([-4.0, 1.0, 0.0]))
    words, keys = features(texts)
    owner, count = words.owner(), words.count
    y = (toxic[owner] == 1) & (signs[_slot(keys[:3])] & signs[_second_slot(keys[:3])]).any(axis=0)
    for part in (keys[:, ~y], keys[:, y]):
        prints[_slot(part)] = _print(part)
    slots = known(prints, keys)
    begins = words.place() == 0
    follows = np.flatnonzero(~begins)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[follows - 1].astype(int), y[follows].astype(int)), 1)
    used = np.unique(slots[slots < SLOTS])
    for _ in range(STEPS):
        emission = weights[slots].sum(axis=0) + bias
        odds, forward, backward = marginals(emission, count, pairs)
        p = _odds(odds)
        # expected label pairs: forward message, potential, emission and backward message of both tokens
        left, right = forward[follows - 1], emission[follows] + backward[follows]
        joint = np.stack([np.full(len(follows), pairs[0, 0]), pairs[0, 1] + right, pairs[1, 0] + left, pairs[1, 1] + left + right])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad = y - p
        g = sum(np.bincount(row, grad, SLOTS + 1) for row in slots) - 0.05 * weights
        sums_w[used] += g[used] ** 2
        weights[used] += 0.7 * g[used] / np.sqrt(sums_w[used])
        sums_b += grad.sum() ** 2
        bias += 0.7 * grad.sum() / np.sqrt(sums_b)
        g = gold - expected - 0.05 * pairs
        sums_p += g**2
        pairs = pairs + 0.3 * g / np.sqrt(sums_p)
    field = Field(weights, prints, bias, pairs, np.zeros(3))
    words, keys = features(judged)
    x, toxic = document_features(field, words, known(prints, keys))[0], judged_toxic
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression, classes weighed as in the corpus
        p = _odds(x @ beta)
        w = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum())) * len(toxic)
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.02 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (w * (toxic - p)) - 0.02 * beta), -2, 2)
    field.score = beta
    return field


def fitted(taught: DataFrame, most: int, signs: np.ndarray, share: float) -> Field:
    """The field of the `most` texts of each class with the smallest hashes, fitted in one task: the sample is bounded, and none of its texts reach the driver."""
    short = taught.where(F.octet_length("text") <= FIT_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    ends = {y: [r.h for r in short.where(F.col("toxic") == y).select("h").orderBy("h").limit(most).collect()][-1:] for y in (0, 1)}
    wanted = F.lit(False)
    for y, last in ends.items():
        if last:
            wanted = wanted | ((F.col("toxic") == y) & (F.col("h") <= last[0]))

    def fit(batches):
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": [], "h": []}, dtype=object), *batches])
        # equal hashes are equal texts, so it is no matter which of them go
        rows = pd.concat([rows[rows["toxic"] == y].sort_values("h").head(most) for y in (1, 0)])
        f = fit_field([t.encode("utf-8", "replace") for t in rows["text"]], rows["toxic"].to_numpy(np.int64), signs, share)
        yield pd.DataFrame({"weights": [f.weights.tobytes()], "prints": [f.prints.tobytes()], "bias": [float(f.bias)], "pairs": [f.pairs.ravel()], "score": [f.score]})

    sample = short.where(wanted).select("text", "toxic", "h").repartition(1)
    rows = sample.mapInPandas(fit, "weights binary, prints binary, bias double, pairs array<double>, score array<double>").collect()
    if not rows:
        return fit_field([], np.zeros(0, np.int64), signs, share)
    f = rows[0]
    return Field(np.frombuffer(f.weights, np.float64), np.frombuffer(f.prints, np.uint32), f.bias, np.array(f.pairs).reshape(2, 2), np.array(f.score))


def document_features(field: Field, words: Words, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: log odds of its likeliest toxic token, and log of the expected number of them; then each token's log odds."""
    odds, _, _ = marginals(field.weights[slots].sum(axis=0) + field.bias, words.count, field.pairs)
    most, total = np.full(len(words.count), -12.0), np.full(len(words.count), 0.0)
    if len(odds):
        full = np.flatnonzero(words.count)
        most[full] = np.clip(np.maximum.reduceat(odds, words.first[:-1][full]), -12, 12)
        total[full] = np.add.reduceat(_odds(odds), words.first[:-1][full])
    return np.column_stack([most, np.log(total + 1e-3)]), odds


def tag(field: Field, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score and toxic spans (byte offsets) of each text; a span is a run of tokens with marginals of 0.5 or more."""
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    for begin, part in chunks(texts):
        words, keys = features(part)
        x, odds = document_features(field, words, known(field.prints, keys))
        scores[begin : begin + len(part)] = _odds(field.score[0] + x @ field.score[1:])
        hot = np.flatnonzero(odds >= 0)
        if len(hot):
            owner, offset = words.owner(), np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
            new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(owner[hot]) > 0)])
            ends = np.append(np.flatnonzero(new)[1:] - 1, len(hot) - 1)
            for a, b in zip(hot[new], hot[ends], strict=True):
                o = owner[a]
                spans[begin + o].append((int(words.start[a] - offset[o]), int(words.end[b] - offset[o])))
    return scores, spans


def toxicity(docs: DataFrame, labels: DataFrame, held_out, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Toxicity of every row of `docs` (doc_id, text; all other columns are carried along).

    `labels` (doc_id, toxic) teaches; `held_out` is a condition on doc_id whose rows it never teaches from. Adds score (0 to 1),
    predicted (1 from 0.5 on) and spans, an array of (start, end) in code points: runs of tokens with toxic marginals of 0.5 or more.

    The texts of LABEL_ROWS labels (all, where there are fewer) give the counts that label tokens (words and beginnings that mark toxic documents); the field is fitted on
    the `fit_docs` documents of each class with the smallest hash, its score on as many others. A null text counts as empty; texts without words get the
    score of no evidence. Repeated rows get equal scores; of several labels of one id the toxic one counts. Rows of labels with a null are
    ignored. Columns named score, predicted or spans are replaced. Without any toxic label every score is low.
    """
    text = F.coalesce("text", F.lit(""))
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = LABEL_ROWS / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    taught = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    taught = written(taught, "toxic-taught")
    signs, share = evidence(taught)
    field = fitted(taught, 2 * fit_docs, signs, share)

    own = [c for c in docs.columns if c not in ("score", "predicted", "spans")]

    def run(batches):
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            raw = [t.encode("utf-8", "replace") for t in texts]
            scores, spans = tag(field, raw)
            out = []
            for r, t, s in zip(raw, texts, spans, strict=True):
                plain = len(r) == len(t)
                point = (lambda i: i) if plain else (lambda i, r=r: len(r[:i].decode("utf-8", "replace")))
                out.append([{"start": point(a), "end": point(b)} for a, b in s])
            yield pdf.assign(score=scores, predicted=(scores >= 0.5).astype(np.int32), spans=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(own).schema)
    return docs.select(own).mapInPandas(run, f"{kinds}, score double, predicted int, spans array<struct<start:int,end:int>>")


def fold(doc_id="doc_id"):
    """True for the fifth of the ids that stays held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"), fold())
    return scored.select("doc_id", fold().alias("held_out"), "score", "predicted", "spans")
