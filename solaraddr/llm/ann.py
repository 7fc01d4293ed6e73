"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import load, partitions, written

#: Vectors that the forest is fitted on at most (by hash), trees, and rows of a leaf that the depth aims at.
FIT_ROWS, TREES, LEAF_ROWS = 32_768, 4, 800
#: Fitted vectors that each leaf needs at least: the depth stops there.
FIT_LEAF = 8
#: Queries that are answered exactly to see how many leaves have to be visited, and the share of true neighbours these have to hold.
TRIALS, HELD = 64, 0.95
#: Bytes of rows, and of queries, that one task compares at once; a leaf of more rows than BLOCK_ROWS is split as long as tasks are few.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 4096
#: Queries, and products of queries and rows, that are at hand at a time.
SLICE, PRODUCTS = 1024, 1 << 20


def depth_for(rows: int) -> int:
    """Levels of a tree: one more for each doubling of the rows, as far as the fitted sample goes. A small table is one leaf."""
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / LEAF_ROWS))))
    return min(depth, int(np.log2(FIT_ROWS / FIT_LEAF)))


class Forest:
    """Trees of `depth` levels: node n splits by direction n at its median; its children are 2n + 1 and 2n + 2."""

    def __init__(self, sample: np.ndarray, longest: float, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.longest = trees, depth, longest
        self.leaves, inner = 1 << depth, (1 << depth) - 1
        x = self.lifted(sample)
        self.direction = np.zeros((trees, inner, x.shape[1]))
        self.cut = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for n in range(inner):
                own = x[node == n]
                d = rng.standard_normal(x.shape[1])
                if len(own) >= 2:
                    a, b = own[rng.integers(len(own), size=2)]
                    d = a - b if np.any(a != b) else d
                d /= np.linalg.norm(d) or 1.0
                p = own @ d
                self.direction[t, n], self.cut[t, n] = d, np.median(p) if len(p) else 0.0
                node[node == n] = np.where(p >= self.cut[t, n], 2 * n + 2, 2 * n + 1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more component, which makes all lengths equal: nearest by distance is then largest by inner product."""
        return np.column_stack([x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over the forest."""
        x = self.lifted(x)
        out = np.zeros((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where((x * self.direction[t, node]).sum(axis=1) >= self.cut[t, node], 2 * node + 2, 2 * node + 1)
            out[t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def search(self, q: np.ndarray, rows: np.ndarray, visits: int, least: int) -> list[int]:
        """The leaves to visit, best first: all trees share a queue ordered by the squared margins that lead away from the query.

        rows: the rows of each leaf; empty leaves are no visits. The search goes on until one tree's leaves hold `least` rows.
        """
        q = np.append(q, 0.0)
        margin = self.direction @ q - self.cut
        queue, found, inner, held = [(-np.inf, t, 0) for t in range(self.trees)], [], self.leaves - 1, np.zeros(self.trees)
        while queue and (len(found) < visits or held.max() < least):
            away, t, n = heapq.heappop(queue)
            while n < inner:
                m = margin[t, n]
                heapq.heappush(queue, ((0 if away == -np.inf else away) + m * m, t, 2 * n + 1 if m >= 0 else 2 * n + 2))
                n = 2 * n + 2 if m >= 0 else 2 * n + 1
            leaf = n - inner + t * self.leaves
            if rows[leaf]:
                found.append(leaf)
                held[t] += rows[leaf]
        return found

    def visits_for(self, queries: np.ndarray, neighbours: list[np.ndarray], rows: np.ndarray, share: float) -> int:
        """Leaves to visit so that `share` of the true neighbours of some queries lie in them."""
        needed = []
        for q, x in zip(queries, neighbours, strict=True):
            if len(x):
                place = np.full(self.trees * self.leaves, len(rows))
                order = self.search(q, rows, len(rows), 0)
                place[order] = np.arange(1, len(order) + 1)
                needed.extend(place[self.route(x)].min(axis=0))
        return int(np.sort(needed)[max(0, int(np.ceil(share * len(needed))) - 1)]) if needed else 1


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all pairs in double precision, summed component by component."""
    out = np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        out += q[:, i, None] * x[None, :, i]
    return out


def paired_products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for the pairs of q[a] and x[b] alone."""
    out = np.zeros(len(a))
    for begin in range(0, len(a), SLICE * 16):
        at = slice(begin, begin + SLICE * 16)
        left, right = q[a[at]], x[b[at]]
        for i in range(q.shape[1]):
            out[at] += left[:, i] * right[:, i]
    return out


def blocks_of(rows: np.ndarray, leaves: int, want: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf, and its number of blocks.

    Leaves of one tree, side by side, fill a block up to `want` rows (at most `most`); a leaf of over `most` rows has blocks of its own.
    """
    first, parts = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // most))
    block = held = 0
    for leaf, n in enumerate(rows.tolist()):
        if held and (leaf % leaves == 0 or held + n > want):
            block, held = block + 1, 0
        first[leaf], held = block, held + n
        if parts[leaf] > 1:
            block, held = block + int(parts[leaf]), 0
    return first, parts


def _leading(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query, by query and best first."""
    order = np.lexsort((ids, -scores, who))
    own = who[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def best_in_block(q: np.ndarray, visited: list, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores, best first, of the k best rows for each query among those leaves of a block that it visits.

    Matrix products tell which rows can be among them, with room for their rounding; the scores of these are summed as everywhere.
    """
    order = np.argsort(leaf, kind="stable")
    x, ids, leaf = x[order], ids[order], leaf[order]
    names, begins = np.unique(leaf, return_index=True)
    room = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    out = []
    for begin in range(0, len(q), SLICE):
        own, slack = q[begin : begin + SLICE], room[begin : begin + SLICE]
        lists = visited[begin : begin + SLICE]
        where, who = np.concatenate(lists), np.repeat(np.arange(len(own)), [len(v) for v in lists])
        floor, hits = np.full(len(own), -np.inf), []
        for name, lo, hi in zip(names, begins, np.append(begins[1:], len(x)), strict=True):
            at, step = who[where == name], max(1, PRODUCTS // (hi - lo))
            for few in (at[i : i + step] for i in range(0, len(at), step)):
                s = own[few] @ x[lo:hi].T
                if hi - lo >= k:
                    floor[few] = np.maximum(floor[few], np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k])
                i, j = np.nonzero(~(s < (floor[few] - slack[few])[:, None]))
                a, b = few[i], lo + j
                scores = paired_products(own, x, a, b)
                keep = _leading(a, ids[b], scores, k)
                hits.append((a[keep], ids[b[keep]], scores[keep]))
        a, found, scores = (np.concatenate(c) for c in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        keep = _leading(a, found, scores, k)
        ends = np.searchsorted(a[keep], np.arange(len(own) + 1))
        out += [(found[keep[lo:hi]], scores[keep[lo:hi]]) for lo, hi in zip(ends, ends[1:])]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def nearest(points: DataFrame, queries: DataFrame, k: int = 20, held: float = HELD) -> DataFrame:
    """The k rows of `points` (vec_id, embedding) with the largest inner products for each row of `queries` (same columns).

    Returns query_id, rank from 1, vec_id, score: nearest first, ties to the smaller id, a query's own id left out. Vectors that
    are null, empty, zero, or hold a null or non-finite component take no part, nor do null ids; vectors of a length other than
    the commonest one neither. Extra columns are ignored; repeated rows of an id count once. No queries or no points: no rows.

    The forest is fitted on FIT_ROWS vectors; its depth grows with the rows, and every row is routed to a leaf of each tree. TRIALS
    queries are answered exactly, against all rows in blocks; as many leaves are visited as hold the share `held` of their true
    neighbours, so that the recall is the same at every size and no more is read than the vectors ask for. A table of one leaf is
    answered exactly. Of equal vectors the k + 1 smallest ids are kept before anything is shuffled (no query can name more), and
    equal queries are searched once.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
        return df.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & fine)

    lengths = valid(points).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["n"]
    alike = valid(points).where(F.size("v") == dim).distinct()
    kept = written(
        alike.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1).select("vec_id", "v", "copy"), "ann-points"
    )
    asked = written(valid(queries).where(F.size("v") == dim).distinct(), "ann-queries")
    distinct = kept.where("copy = 1")
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    share = FIT_ROWS / max(1, facts["n"])
    picked = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * FIT_ROWS).select("v").toPandas()
    sample = np.array(picked["v"].tolist(), float).reshape(-1, dim)
    forest = Forest(sample, float(facts["longest"] or 0.0) ** 0.5, depth_for(facts["n"]))

    def leaves(batches):
        for pdf in batches:
            if len(pdf):
                for leaf in forest.route(np.array(pdf["v"].tolist(), float)):
                    yield pd.DataFrame({"leaf": leaf})

    counts = kept.mapInPandas(leaves, "leaf long").groupBy("leaf").count().toPandas()  # a row a leaf
    rows = np.zeros(forest.trees * forest.leaves, np.int64)
    rows[counts["leaf"]] = counts["count"]
    trials = asked.select("v").distinct().orderBy(F.xxhash64("v")).limit(TRIALS).toPandas()
    tried = np.array(trials["v"].tolist(), float).reshape(-1, dim)

    def answered(batches):
        for pdf in batches:
            if len(pdf) and len(tried):
                x = np.array(pdf["v"].tolist(), float)
                for i, s in enumerate(inner_products(tried, x)):
                    at = _best(pdf["vec_id"].to_numpy(np.int64), s, k + 1)
                    yield pd.DataFrame({"trial": i, "score": s[at], "vec_id": pdf["vec_id"].iloc[at], "v": pdf["v"].iloc[at]})

    exact = kept.mapInPandas(answered, "trial int, score double, vec_id long, v array<double>")
    best_first = Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id")
    truth = exact.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= k + 1).select("trial", "v").toPandas()
    neighbours = [np.array(truth["v"][truth["trial"] == i].tolist(), float).reshape(-1, dim) for i in range(len(tried))]
    visits = forest.visits_for(tried, neighbours, rows, held)
    vectors = asked.groupBy("v").agg(F.min("vec_id").alias("query"))
    cap = max(1, BLOCK_BYTES // (8 * dim))
    want = min(cap, int(rows.sum()) // partitions(points.sparkSession))
    first, parts = blocks_of(rows, forest.leaves, want, min(cap, max(want, BLOCK_ROWS)))
    shares = max(1, -(-vectors.count() // cap))
    kind = "<f4" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (points, queries)) else "<f8"

    def packed(x):
        return [r.tobytes() for r in x.astype(kind)]

    def unpacked(v):
        return np.frombuffer(b"".join(v), kind).reshape(-1, dim).astype(float)

    def probe(batches):
        """A row for each block that a query visits, with the leaves it visits there."""
        for pdf in batches:
            for few in (pdf.iloc[i : i + max(1, cap // visits)] for i in range(0, len(pdf), max(1, cap // visits))):
                x = np.array(few["v"].tolist(), float)
                found = [forest.search(q, rows, visits, k + 1) for q in x]
                leaf, at = np.array([n for f in found for n in f], np.int64), np.repeat(np.arange(len(x)), [len(f) for f in found])
                many = parts[leaf]
                block = np.repeat(first[leaf], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at, leaf = np.repeat(at, many), np.repeat(leaf, many)
                order = np.lexsort((block, at))
                at, leaf, block = at[order], leaf[order], block[order]
                begins = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(block) != 0))[: len(at)])
                query, v = few["query"].to_numpy(np.int64)[at[begins]], packed(x)
                yield pd.DataFrame({"cell": block[begins] * shares + query % shares, "query": query, "v": [v[i] for i in at[begins]], "leaves": np.split(leaf, begins[1:]) if len(begins) else []})

    def dealt(batches):
        """Each row at its leaf of each tree, once for each share of the queries."""
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float)
                ids, v = pdf["vec_id"].to_numpy(np.int64), packed(x)
                for leaf in forest.route(x):
                    for share in range(shares):
                        yield pd.DataFrame({"cell": (first[leaf] + ids % parts[leaf]) * shares + share, "leaf": leaf, "vec_id": ids, "v": v})

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})
        best = best_in_block(unpacked(left["v"]), left["leaves"].tolist(), unpacked(right["v"]), right["vec_id"].to_numpy(np.int64), right["leaf"].to_numpy(np.int64), k + 1)
        return pd.DataFrame({"query": left["query"].to_numpy(), "ids": [b[0] for b in best], "scores": [b[1] for b in best]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks of one query: a list of k + 1 at most from each."""
        ids, first = np.unique(np.concatenate(pdf["ids"].tolist()), return_index=True)
        scores = np.concatenate(pdf["scores"].tolist())[first]
        at = _best(ids, scores, k + 1)
        return pd.DataFrame({"query": [pdf["query"].iloc[0]], "found": [[{"vec_id": int(i), "score": float(s)} for i, s in zip(ids[at], scores[at], strict=True)]]})

    left = vectors.mapInPandas(probe, "cell long, query long, v binary, leaves array<long>")
    right = kept.mapInPandas(dealt, "cell long, leaf long, vec_id long, v binary")
    lists = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(rank, "query long, ids array<long>, scores array<double>")
    found = lists.groupBy("query").applyInPandas(merge, "query long, found array<struct<vec_id:long,score:double>>")
    answers = vectors.join(found, "query").select("v", "found")
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
