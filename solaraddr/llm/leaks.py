"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import load, written
from .words import Words, chunks, mixed, window_hashes

#: Words of a shingle, least similarity, and the Hamming radius: two windows of similarity 0.8 differ in 19 of 128 bits, give or take 4.
SHINGLE, SIMILAR, RADIUS = 5, 0.8, 31
#: 128-bit fingerprints in 8 blocks of 16 bits: within RADIUS, some block differs in RADIUS // 8 bits or fewer.
BLOCKS, BLOCK_BITS = 8, 16
#: Items that one pass over the documents holds; more are searched in further passes.
SLICE = 2000
#: A text shorter than an item is compared with it as a whole, down to this share of its words: shorter ones cannot be similar.
SHORTEST = 0.8
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_MASKS = np.array([m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS], np.uint16)


def _grams(words: Words, h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each word on (0 past the end)."""
    out = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        out[: len(h) - size + 1] = mixed(window_hashes(h, size) + np.uint64(size))
    return out


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    words = Words(texts, lower=True)
    words.trim()
    return words, words.hashes()


def fingerprints(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: BLOCKS numbers. Components are roots of weights, so that equal shares of weight make equal angles."""
    both = np.stack([grams, mixed(grams + np.uint64(29))], axis=-1)
    bits = np.unpackbits(both.astype(">u8").view(np.uint8).reshape(*grams.shape, 16), axis=-1)
    return np.packbits(np.einsum("wk,wkb->wb", np.sqrt(weights), 2.0 * bits - 1) > 0, axis=1).view(np.uint16)


@dataclass
class Index:
    """Items of one size with their fingerprints, and for each block a table of all values within RADIUS // BLOCKS bits of theirs."""

    size: int
    shingle: int
    ids: np.ndarray
    grams: np.ndarray
    prints: np.ndarray

    def __post_init__(self):
        self.tables = []
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ _MASKS[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], np.repeat(np.arange(len(self.ids)), len(_MASKS))[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all fingerprints within RADIUS: rows look their blocks up in the tables, then whole fingerprints are compared."""
        found = []
        for b, (values, items) in enumerate(self.tables):
            low, high = np.searchsorted(values, prints[:, b], "left"), np.searchsorted(values, prints[:, b], "right")
            n = high - low
            rows = np.repeat(np.arange(len(prints)), n)
            found.append(rows * len(self.ids) + items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        pair = np.unique(np.concatenate(found))
        row, item = pair // len(self.ids), pair % len(self.ids)
        apart = _ONES[(prints[row] ^ self.prints[item]).view(np.uint8)].sum(axis=1)
        return row[apart <= RADIUS], item[apart <= RADIUS]


@dataclass
class Items:
    indexes: list[Index]
    grams: np.ndarray
    weights: np.ndarray
    usual: float

    def weight(self, grams: np.ndarray) -> np.ndarray:
        """Rarer among the items is heavier; shingles of no item weigh as much as the rarest."""
        if not len(self.grams):
            return np.full(grams.shape, self.usual)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.weights[at], self.usual)


def item_grams(texts: list[bytes]) -> list[np.ndarray]:
    """The shingles of each item in order; of one shorter than a shingle, the whole of it."""
    words, h = _words(texts)
    out = []
    for first, n in zip(words.first[:-1], words.count, strict=True):
        k = min(SHINGLE, int(n))
        out.append(mixed(window_hashes(h[first : first + n], k) + np.uint64(k)) if n else np.zeros(0, np.uint64))
    return out


def index_items(ids: list[int], texts: list[bytes], frequencies: tuple[np.ndarray, np.ndarray, int] | None = None) -> Items:
    """Items ready to be searched. frequencies: shingles (sorted), in how many items each is, and how many items there are; by default of these items."""
    own = item_grams(texts)
    sizes = np.array([len(g) + min(SHINGLE, n) - 1 if (n := len(t.split())) else 0 for g, t in zip(own, texts, strict=True)], np.int64)
    if frequencies is None:
        held = [np.unique(g) for g in own if len(g)]
        grams, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
        frequencies = grams, df, len(held)
    grams, df, n_items = frequencies
    items = Items([], grams, np.log(1 + n_items / np.maximum(df, 1)), float(np.log(1 + n_items)))
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        g = np.stack([own[i] for i in at])
        items.indexes.append(Index(int(n), min(SHINGLE, int(n)), np.array([ids[i] for i in at]), g, fingerprints(g, items.weight(g))))
    return items


def similarity(a: np.ndarray, b: np.ndarray, items: Items) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    a, b = np.unique(a), np.unique(b)
    both = items.weight(np.intersect1d(a, b, assume_unique=True)).sum()
    return float(both / max(1e-12, items.weight(a).sum() + items.weight(b).sum() - both))


def leaks_in(texts: list[bytes], items: Items) -> list[list[tuple[int, int, int, float]]]:
    """For each text its leaks (item, first word, words, similarity): the most similar window of each item.

    A window that shares no shingle with any item has similarity 0 to all, so only windows around shared shingles are fingerprinted.
    """
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for begin, part in chunks(texts):
        words, h = _words(part)
        owner = None
        shared = {}
        for index in items.indexes:
            k = index.shingle
            if k not in shared:
                g = _grams(words, h, k)
                at = words.windows(k)
                if len(at) and len(items.grams):
                    place = np.minimum(np.searchsorted(items.grams, g[at]), len(items.grams) - 1)
                    at = at[items.grams[place] == g[at]]
                shared[k] = g, at
            g, hits = shared[k]
            hits = hits[np.isin(g[hits], index.grams)]
            if not len(hits):
                continue
            owner = words.owner() if owner is None else owner
            # every item-sized window of the same text that holds a hit
            first, last = words.first[:-1][owner[hits]], words.first[1:][owner[hits]] - index.size
            low, high = np.maximum(first, hits - (index.size - k)), np.minimum(last, hits)
            mark = np.zeros(len(h) + 2, np.int64)
            fine = low <= high
            np.add.at(mark, low[fine], 1)
            np.add.at(mark, high[fine] + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark) > 0)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for o in np.unique(owner[hits][words.count[owner[hits]] < index.size]):
                n = int(words.count[o])
                if n < max(k, SHORTEST * index.size):
                    continue
                whole = g[words.first[o] : words.first[o] + n - k + 1]
                for i in index.near(fingerprints(whole[None], items.weight(whole[None])))[1]:
                    value = similarity(whole, index.grams[i], items)
                    if value >= SIMILAR - 1e-9:
                        out[begin + o].append((int(index.ids[i]), 0, n, value))
            for s in np.array_split(starts, max(1, len(starts) // 2000)):
                if not len(s):
                    continue
                window = g[s[:, None] + np.arange(index.size - k + 1)]
                prints = fingerprints(window, items.weight(window))
                for w, i in zip(*index.near(prints), strict=True):
                    value = similarity(window[w], index.grams[i], items)
                    if value >= SIMILAR - 1e-9:
                        key = int(owner[s[w]]), int(i)
                        best[key] = max(best.get(key, (0.0, 0)), (value, -int(s[w] - words.first[key[0]])))
            for (o, i), (value, start) in best.items():
                out[begin + o].append((int(index.ids[i]), -start, index.size, value))
    return [sorted(x) for x in out]


def mark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds `leaks` to every row of `docs` (text; other columns stay): an array of (item_id, start, n_words, similarity).

    Items of `benchmark` (item_id, text) and windows of as many words are compared by their 5-word shingles, A-Z lower-cased and
    without outer punctuation; shorter items are one shingle. A leak has a weighted Jaccard similarity of 0.8 or more; of each
    item the most similar window is given. A text shorter than an item is one window. Items without words or id match nothing,
    null texts have no leaks, repeated rows and repeated items are each judged; a column named leaks is replaced. Items are held
    in slices of SLICE; each slice is one pass, and none is left out. Windows that share no shingle with an item are not looked at:
    their similarity is 0. Of the others, fingerprints within RADIUS are found without fail; that a pair of similarity 0.8 lies
    within it is likely (its distance is three deviations below), not certain.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")

    def spelled(batches):
        for pdf in batches:
            grams = item_grams([t.encode("utf-8", "replace") for t in pdf["text"]])
            yield pd.DataFrame({"item_id": pdf["item_id"], "g": [np.unique(g).view(np.int64) for g in grams]})

    grams = written(items.mapInPandas(spelled, "item_id long, g array<long>").where("size(g) > 0").select("item_id", F.explode("g").alias("g")), "leak-grams")
    # frequencies are over all items, so that no slice changes a similarity
    df = written(grams.groupBy("g").agg(F.count("*").alias("n")), "leak-frequencies")
    worded = grams.select("item_id").distinct().count()
    slices = max(1, -(-items.count() // SLICE))
    of_slice = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(slices)) == n
    own = [c for c in docs.columns if c != "leaks"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(own).schema)
    kind = "array<struct<item_id:long,start:int,n_words:int,similarity:double>>"
    out = docs.select(*own, F.lit(None).cast(kind).alias("leaks"))
    for n in range(slices):
        held = items.where(of_slice(n)).orderBy("item_id", "text").collect()
        known = df.join(grams.where(of_slice(n)).select("g").distinct(), "g").toPandas()
        keys = known["g"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        index = index_items([r["item_id"] for r in held], [r["text"].encode("utf-8", "replace") for r in held], (keys[order], known["n"].to_numpy()[order], worded))

        def run(batches, index=index):
            for pdf in batches:
                found = leaks_in([(t or "").encode("utf-8", "replace") for t in pdf["text"]], index)
                rows = [[dict(zip(("item_id", "start", "n_words", "similarity"), x, strict=True)) for x in f] for f in found]
                before = [list(b) if b is not None else [] for b in pdf["leaks"]]
                yield pdf[own].assign(leaks=pd.Series([b + r for b, r in zip(before, rows, strict=True)], index=pdf.index, dtype=object))

        out = out.mapInPandas(run, f"{kinds}, leaks {kind}")
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    marked = mark_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    found = marked.select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.start", "x.n_words", F.round("x.similarity", 6).alias("similarity"))
