"""URL filter: host/path rules, and a character language-model ratio for the urls that no rule decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ascii_lower, load, partitions, written
from .words import mixed

#: Rules of the registered query: (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Longest context in bytes, and n-grams of a model that is sent to every task: a larger one stays a table that urls are joined with (see `filter_urls`).
ORDER, MODEL_GRAMS = 5, 4_000_000
#: Bytes of distinct urls that one task scores against a joined model, about.
CHUNK_BYTES = 1 << 19
#: Bins of the score histogram that the threshold is calibrated on, over scores from -SPAN to SPAN a byte.
BINS, SPAN = 400, 4.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits host or a parent domain and starts the path; ties by code point. For lists of up to some hundred rules."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        found = found.when(((host == own) | host.endswith(f".{own}")) & path.startswith(start), F.lit(rule))
    return found


def _grams(urls: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each byte, and for each order the 64-bit keys of its context and of context + byte. Texts end in byte 0."""
    texts = [u.encode("utf-8", "replace") + b"\0" for u in urls]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lens)
    at = np.arange(len(buf)) - np.repeat(np.cumsum(lens) - lens, lens)
    out, context = [], np.zeros(len(buf), np.uint64)
    for order in range(ORDER + 1):
        if order:
            # up to five bytes and a mark for each that lies before the text: exact, not hashed
            shifted = np.concatenate([np.zeros(order, np.uint64), buf[:-order]]) + np.uint64(1)
            context = context * np.uint64(257) + np.where(at >= order, shifted, 0)
        own = context * np.uint64(8) + np.uint64(order)
        out.append((own, mixed(own + np.uint64(0x9E3779B97F4A7C15)) + buf))
    return row, out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The n-grams of each slice of urls, of accepted and of rejected ones: key, counts."""
    for pdf in batches:
        for part in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 2000)):
            if not len(part):
                continue
            rejected = pdf["rejected"].to_numpy()[part].astype(bool)
            row, grams = _grams(pdf["url"].iloc[part].tolist())
            keys, at = np.unique(np.concatenate([k for pair in grams for k in pair]), return_inverse=True)
            bad = np.tile(rejected[row], 2 * len(grams))
            yield pd.DataFrame({"g": keys.view(np.int64), "good": np.bincount(at, ~bad, len(keys)).astype(np.int64), "bad": np.bincount(at, bad, len(keys)).astype(np.int64)})


def fit_counts(labelled: DataFrame) -> DataFrame:
    """Exact counts of contexts and n-grams in accepted and rejected urls, over all rows of (url, rejected): g, good, bad.

    Counted in tasks and summed in Spark by n-gram, so they grow with the corpus; none is dropped at any size.
    """
    return written(labelled.mapInPandas(_count, "g long, good long, bad long").groupBy("g").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")


def as_model(counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fit_counts as sorted keys and counts (2, n)."""
    keys = counts["g"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([counts["good"].to_numpy(float), counts["bad"].to_numpy(float)])[:, order]


def _seen(model: tuple[np.ndarray, np.ndarray], label: int, keys: np.ndarray) -> np.ndarray:
    known, counts = model
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[label][at], 0.0)


def log_ratio(model: tuple[np.ndarray, np.ndarray], urls: list[str]) -> np.ndarray:
    """Mean over the bytes of log P(byte | rejected) - log P(byte | accepted).

    P interpolates the orders: each longer context mixes its own frequencies with the shorter one's estimate, by n / (n + 2)
    (so an unseen context falls back wholly), down to a uniform byte.
    """
    if not urls:
        return np.zeros(0)
    row, grams = _grams(urls)
    logs = []
    for label in (1, 0):
        p = np.full(len(row), 1 / 256)
        for context, symbol in grams:
            n = _seen(model, label, context)
            p = (np.minimum(_seen(model, label, symbol), n) + 2.0 * p) / (n + 2.0)
        logs.append(np.log(p))
    return np.bincount(row, logs[0] - logs[1], len(urls)) / np.bincount(row, minlength=len(urls))


def _scored(model, keep: list[str], out: list[str]):
    def run(batches):
        for pdf in batches:
            parts = [log_ratio(model, pdf["url"].iloc[p].tolist()) for p in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 2000))]
            pdf = pdf[keep].assign(score=np.concatenate(parts) if len(pdf) else np.zeros(0))
            yield pdf[out]

    return run


def joined_scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, score) of each distinct url, where the model is too large for a task.

    Distinct urls are dealt by hash to chunks of about CHUNK_BYTES. A chunk asks for the n-grams that it holds, each once, and is
    scored with those alone: they are all that its urls look up. An n-gram that every url has is asked for once a chunk.
    """
    urls = urls.distinct()
    total = urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    chunks = max(partitions(urls.sparkSession), -(-total // CHUNK_BYTES))
    dealt = written(urls.withColumn("chunk", F.pmod(F.xxhash64("url"), F.lit(chunks))), "url-chunks")

    def asks(pdf: pd.DataFrame) -> pd.DataFrame:
        _, grams = _grams(pdf["url"].tolist())
        keys = np.unique(np.concatenate([k for pair in grams for k in pair]))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "g": keys.view(np.int64)})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"url": left["url"], "score": log_ratio(as_model(right), left["url"].tolist())})

    known = dealt.groupBy("chunk").applyInPandas(asks, "chunk long, g long").join(counts, "g").select("chunk", "g", "good", "bad")
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(score, "url string, score double")


def calibrate(hist: pd.DataFrame) -> float:
    """The threshold with the least balanced error on held-out labelled urls; the middle one of equals. 0 without both labels."""
    table = np.zeros((2, BINS))
    for r in hist.itertuples():
        table[int(r.rejected), int(r.bin)] = r.n
    good, bad = table[0].sum(), table[1].sum()
    if not good or not bad:
        return 0.0
    missed = np.concatenate([[0], np.cumsum(table[1])]) / bad
    blamed = 1 - np.concatenate([[0], np.cumsum(table[0])]) / good
    best = np.flatnonzero(missed + blamed <= (missed + blamed).min() + 1e-12)
    return float(best[len(best) // 2]) / BINS * 2 * SPAN - SPAN


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", most: int = MODEL_GRAMS) -> DataFrame:
    """Judges the url of every row of `pages`: id, url, host, path, rule, score, verdict (allow or block).

    A rule decides where one fits. The urls that rules decide are the accepted and rejected examples: four fifths of them (by
    hash) train two smoothed Markov models of variable order, the rest calibrates the threshold on the length-normalised log-likelihood ratio.
    Urls that no rule decides are blocked above that threshold. Null urls have empty parts and are judged as empty texts.
    Repeated rows stay and get equal verdicts; with no labelled urls the score is 0 and the verdict allow; no pages, no rows. Very long
    urls are scored whole. Extra columns are ignored.

    A model of up to `most` n-grams is broadcast; a larger one is joined with the urls (`joined_scores`). Both hold the same counts, so
    scores and verdicts do not depend on which of them runs.
    """
    rules = tuple(rules)
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col), F.col("url")).withColumn("host", host).withColumn("path", path).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    blocks = [rule for verdict, rule in rules if verdict == "block"]
    parts = written(parts, "url-parts")
    labelled = parts.where(F.col("rule").isNotNull()).select("url", F.col("rule").isin(blocks).alias("rejected"))
    fold = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = fit_counts(labelled.where(~fold))
    fits = counts.limit(most + 1).count() <= most
    model = as_model(counts.toPandas()) if fits else None

    def scored(df: DataFrame, columns: list[str]) -> DataFrame:
        if not fits:
            return df.select(columns).join(joined_scores(df.select("url"), counts), "url").select(*columns, "score")
        kinds = dict(df.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double"

        def run(batches):
            return _scored(model, columns, [*columns, "score"])(batches)

        return df.mapInPandas(run, schema)

    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    held = scored(labelled.where(fold).withColumn("rejected", F.col("rejected").cast("int")), ["rejected", "url"])
    limit = calibrate(held.groupBy("rejected", at.alias("bin")).agg(F.count("*").alias("n")).toPandas())
    result = scored(parts.withColumn("url", F.coalesce("url", F.lit(""))), [id_col, "url", "host", "path", "rule"])
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocks), "block").otherwise("allow")).when(F.col("score") > limit, "block").otherwise("allow")
    return result.withColumn("verdict", verdict)


def op3(spark, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
