"""n-gram Jaccard join by prefixes under several global token orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import order_keys, prefix_size, shingle_sets
from .substrings import _NULL_ID, _anchor_messages, _exchange, _groups, _records, deal, plain, squeeze, unpack
from .tables import discard, load, partitions, parts_for, small, written
from .words import chunks, mixed

#: Token orders that candidates have to agree on; counts of a set's tokens in this many buckets bound what two sets share.
ORDERS, BUCKETS = 3, 64
#: Sets from this size on are also counted in so many buckets, which smaller ones leave empty.
LARGE, FINE = 820, 256
#: Sets of up to so many tokens send 16 bits of each with their marks, which bound closely what two of them share.
SHORT = 512
#: Share of all tokens, beyond the share in which two linked sets may differ, that is looked up among all sets.
LOOKED_UP = 0.2
#: Pairs, and bytes of the sets they name, that one task compares, about.
BLOCK_PAIRS, BLOCK_BYTES = 8000, 32 << 20
#: First tokens of a prefix that go with each of its tokens, so that nearly all pairs are found under one token, not under all they share.
HEADS = 8
_TOKENS = [("h", "<u8"), ("doc", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("heads", "<u8", (HEADS,)), ("sketch", "u1", (BUCKETS,)), ("fine", "u1", (FINE,))]
_PAIR_ROWS = 1 << 21
#: Pairs of each class that are compared first.
FIRST_PAIRS = 8
#: Of a token that more than CROWD rows have, each row is first paired with so many more of them.
CROWD, AROUND = 32, 24


def _digests(tokens: np.ndarray) -> tuple[int, int]:
    a, b = (int(np.add.reduce(mixed(tokens + np.uint64(k)))) if len(tokens) else 0 for k in (11, 23))
    return a - (1 << 63), b - (1 << 63)


def _sorted_from(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
    """The tokens whose hash under the first order is in [low, high), in that order."""
    key = order_keys(tokens, 0)
    inside = np.flatnonzero((key >= np.uint64(low)) & (key < np.uint64(high)))
    return tokens[inside[np.argsort(key[inside], kind="stable")]]


def _threshold(percent: int) -> int:
    return int(min(1.0, LOOKED_UP + 1 - percent / 100) * (2**63 - 1)) * 2


def _pool(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The tokens that are looked up: those below a threshold that is the same for all sets, in the first order."""
    return _sorted_from(tokens, 0, _threshold(percent))


def _prefix(tokens: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set's prefix that another set may have in its own; `shared`: places in the pool of those that others hold.

    The first order: tokens of the pool that no other set holds, then those that others do, then the rest, each by hash. It is the
    same for all sets, and what only one set holds can link it to nothing.
    """
    first, size = _pool(tokens, percent), prefix_size(len(tokens), percent)
    alone = len(first) - len(shared)
    if alone >= size:
        return first[:0]
    return np.concatenate([first[shared], _sorted_from(tokens, _threshold(percent), 2**64 - 1)])[: size - alone]


def _marks(tokens: np.ndarray, percent: int) -> bytes:
    """16 bits of each token of the prefixes under the other orders, and how many there are; then of all tokens of a short set."""
    size, out = prefix_size(len(tokens), percent), []
    for k in range(1, ORDERS):
        key = order_keys(tokens, k)
        first = tokens[np.argpartition(key, size - 1)[:size]] if size < len(tokens) else tokens
        own = np.unique((mixed(first) >> np.uint64(48)).astype("<u2"))
        out.append(len(own).to_bytes(4, "little") + own.tobytes())
    own = (mixed(tokens) >> np.uint64(48)).astype("<u2") if len(tokens) <= SHORT else np.zeros(0, "<u2")
    return b"".join([*out, len(own).to_bytes(4, "little"), own.tobytes()])


def _spelled_marks(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(np.frombuffer(data, "<u2", n, at + 4))
        at += 4 + 2 * n
    return [*out, np.unique(out[-1])]


def _counts(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return np.minimum(np.bincount((tokens >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets), 255).astype(np.uint8)


def _sketch(tokens: np.ndarray) -> bytes:
    fine = _counts(tokens, FINE) if len(tokens) >= LARGE else np.zeros(FINE, np.uint8)
    return np.concatenate([_counts(tokens, BUCKETS), fine]).tobytes()


def _may_link(tokens: np.ndarray, x: np.ndarray, y: np.ndarray, share: float):
    """The pairs of rows x and y (each of one token), as documents, that their sizes and bucket counts do not rule out; third, a weight.

    A pair whose first tokens meet is left to the first token they have in common, and weighs as much as they have in common.
    """
    doc, n, sketch, heads = tokens["doc"], tokens["n"], tokens["sketch"], tokens["heads"]
    for part in np.array_split(np.arange(len(x)), max(1, len(x) >> 16)):
        a, b = x[part], y[part]
        met = (heads[a][:, :, None] == heads[b][:, None, :]).any(axis=2) & (heads[a] != 0)
        weight = met.sum(axis=1)
        own = (weight == 0) | (heads[a][np.arange(len(a)), met.argmax(axis=1)] == tokens["h"][a])
        a, b, weight = a[own], b[own], np.maximum(weight[own], 1)
        for counts in (sketch, tokens["fine"]):
            apart = np.abs(counts[a].astype(np.int16) - counts[b]).sum(axis=1)
            near = apart * (1 + share) <= (1 - share) * (n[a].astype(np.int64) + n[b]) + 1e-6
            if counts is not sketch:
                near |= np.minimum(n[a], n[b]) < LARGE
            a, b, weight = a[near], b[near], weight[near]
        a, b = doc[a], doc[b]
        yield np.stack([np.maximum(a, b), np.minimum(a, b), weight], axis=1)


def _sample(tokens: np.ndarray, share: float):
    """Of the rows with one prefix token, each with the one before it and with the first: about as many pairs as rows.

    Where more than CROWD rows have the token, also with AROUND more before it: most of a dense group is joined by those pairs.
    `comp` is the smallest id of each class here, so that the first is the oldest text.
    """
    order = np.lexsort((tokens["doc"], tokens["comp"], tokens["h"]))
    new = np.concatenate([[True], tokens["h"][order][1:] != tokens["h"][order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(~new)
    begin = np.flatnonzero(new)
    first = begin[np.cumsum(new) - 1]
    for other in (first[at], at - 1):
        yield from _may_link(tokens, order[at], order[other], share)
    place = np.arange(len(order)) - first
    many = np.diff(np.append(begin, len(order)))
    crowded = np.repeat(many, many) > CROWD
    for k in range(2, AROUND + 2):
        at = np.flatnonzero(crowded & (place > k))
        yield from _may_link(tokens, order[at], order[at - k], share)


def _pairs(tokens: np.ndarray, share: float):
    """Candidate pairs of documents that share a prefix token and are in different components.

    Of the rows with one token those of its largest component are only paired with the others, never with each other.
    """
    order, _, size = _groups(tokens["h"])
    begin = np.cumsum(size) - size
    for first, m in zip(begin[size > 1], size[size > 1], strict=True):
        rank = order[first : first + m]
        comp, label, many = np.unique(tokens["comp"][rank], return_inverse=True, return_counts=True)
        if len(comp) == 1:
            continue
        by = np.argsort(tokens["n"][rank], kind="stable")
        rank, label = rank[by], label[by]
        sizes = tokens["n"][rank].astype(np.int64)
        rest = label != many.argmax()
        own = np.flatnonzero(rest)
        # by size, so that partners are the rows from the smallest to the largest size allowed
        low = np.searchsorted(sizes, np.ceil(sizes[own] * share - 1e-9), side="left")
        counts = np.searchsorted(sizes, np.floor(sizes[own] / share + 1e-9), side="right") - low
        for at in np.split(np.arange(len(own)), np.searchsorted(np.cumsum(counts), np.arange(1, counts.sum() // _PAIR_ROWS + 1) * _PAIR_ROWS)):
            i = np.repeat(own[at], counts[at])
            j = np.repeat(low[at] - np.cumsum(counts[at]) + counts[at], counts[at]) + np.arange(len(i))
            wanted = (label[i] != label[j]) & (~rest[j] | (i < j))
            yield from _may_link(tokens, rank[i[wanted]], rank[j[wanted]], share)


def agree(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> bool:
    """Whether two sets' prefixes share a token under every other order and, if both are short, enough tokens at all, as far as marks tell.

    Tokens of one set that are equal in 16 bits may all be shared, so as many as either set has more are granted.
    """
    *first, x, ux = a
    *second, y, uy = b
    if len(x) and len(y):
        both = len(np.intersect1d(ux, uy, assume_unique=True)) + min(len(x) - len(ux), len(y) - len(uy))
        if (100 + percent) * both < percent * (len(x) + len(y)):
            return False
    return all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(first, second, strict=True))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is large enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def row_key() -> list[Column]:
    """What tells rows of documents apart: the id (null as the smallest) and a hash of the text. Repeated rows are alike in both."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of rows of `docs` (doc_id, text) linked by 100 * |A and B| >= percent * |A or B| over their sets of `size`-word shingles.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text with fewer words is one shingle; without words it is linked with
    nothing. Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links (its own without any).

    Equal sets are one class from the start. Of each class the tokens below a hash threshold are looked up among all classes: a
    class with more tokens of its own than a link allows is linked with nothing, and only the others go on. Those that share a
    token in their prefixes under the first order become candidates; sizes and bucket counts bound what a pair can share, and the
    prefixes under the other orders have to share a token too, before any set is sent. Each class is first compared with a few others,
    then every candidate pair whose classes are still in different components, one pair a class and direction before the others: no link
    between components is lost, and a group of near copies costs about its size in comparisons of sets. Pairs are dealt by one of their classes, split where it has many.

    Null texts are empty. A null doc_id counts as the smallest. Equal rows are in one class; different texts under one id are
    separate. Extra columns are ignored. Classes are told apart by 64 bits of their sets where pairs are formed.
    """
    return marked_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def marked_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """similar_groups with, for each row, its key (doc, t; see row_key) and `kept`: whether that key leads its group.

    One key leads each group: the smallest of its smallest id. A text without words leads itself.
    """
    spark, share = docs.sparkSession, percent / 100
    parts = parts_for(docs)
    base = docs.select(*row_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def sets_in(texts):
        return [s for _, part in chunks(texts) for s in shingle_sets(part, size)]

    def profile(batches):
        for pdf in batches:
            sets = sets_in([bytes(t) for t in pdf["text"]])
            d = np.array([_digests(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc": pdf["doc"], "t": pdf["t"], "n": [len(s) for s in sets], "d1": d[:, 0], "d2": d[:, 1]})

    def one_each(batches):
        """Of the texts of one class in a batch only the first goes on."""
        for pdf in batches:
            texts = [bytes(t) for t in pdf["text"]]
            digests = [_digests(s) if len(s) else None for s in sets_in(texts)]
            first = {}
            for i, d in enumerate(digests):
                if d is not None:
                    first.setdefault(d, i)
            at = list(first.values())
            yield pd.DataFrame({"id": pdf["doc"].to_numpy()[at], "d1": [d[0] for d in first], "d2": [d[1] for d in first], "text": squeeze([texts[i] for i in at])})

    # `doc` names a class in the exchange: 40 bits of one digest, beside 31 of the other
    name, tag = F.shiftright("d1", 24), F.col("d2").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    sent = base.mapInPandas(one_each, "id long, d1 long, d2 long, text binary").select(name.alias("doc"), tag.alias("tag"), "id", "d1", "d2", "text").repartition(parts, "doc")
    texts = sent.groupBy("doc", "tag", "d1", "d2").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("doc", "tag", "id", "d1", "text")
    rows = written(base.mapInPandas(profile, "doc long, t long, n int, d1 long, d2 long"), "jaccard-rows")

    def pool_tokens(part, doc, pdf):
        pools = [_pool(s, percent) for s in shingle_sets(part, size)]
        count = np.array([len(x) for x in pools], np.int64)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return _records("anchor", h=np.concatenate([*pools, np.zeros(0, np.uint64)]), doc=np.repeat(doc, count), tag=np.repeat(pdf["tag"].to_numpy(), count), at=place)

    # both uses read the same columns of `texts`, so that its exchange is made once
    met = _exchange(texts, pool_tokens, "anchor", _anchor_messages, parts)

    def survivors(batches):
        """Classes that may be linked: their texts, prefix tokens, bucket counts and marks."""
        for pdf in batches:
            found = []
            for begin, part in chunks(plain(pdf["text"])):
                for i, s in enumerate(shingle_sets(part, size), begin):
                    blobs = pdf["blobs"].iloc[i]
                    own = [np.frombuffer(b, "<i4") for b in map(bytes, blobs if blobs is not None else ())]
                    own = [x[1:] for x in own if x[0] == pdf["tag"].iloc[i]]
                    p = _prefix(s, np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64), percent)
                    if len(p):
                        found.append((pdf["d1"].iloc[i], pdf["id"].iloc[i], len(s), p.tobytes(), _sketch(s), _marks(s, percent), bytes(pdf["text"].iloc[i])))
            yield pd.DataFrame(found, columns=["d1", "id", "n", "prefix", "sketch", "marks", "text"])

    near = texts.join(met.hint("shuffle_hash"), "doc", "left").select(*texts.columns, "blobs")
    found = near.mapInPandas(survivors, "d1 long, id long, n int, prefix binary, sketch binary, marks binary, text binary")
    # short numbers, fixed once they are written
    nodes = written(found.withColumn("doc", F.monotonically_increasing_id()), "jaccard-nodes")

    def spread(batches):
        for pdf in batches:
            for piece in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 1000)):
                found = []
                for r in pdf.iloc[piece].itertuples():
                    h = np.frombuffer(bytes(r.prefix), "<u8")
                    x = np.empty(len(h), _TOKENS)
                    counts = np.frombuffer(bytes(r.sketch), np.uint8)
                    x["h"], x["doc"], x["comp"], x["n"], x["sketch"], x["fine"] = h, r.doc, r.comp, r.n, counts[:BUCKETS], counts[BUCKETS:]
                    x["heads"] = 0
                    x["heads"][:, : len(h)] = h[:HEADS]
                    found.append(x)
                if found:
                    yield deal(np.concatenate(found), parts, _TOKENS)

    def proposed(known: DataFrame | None, make) -> DataFrame:
        """Pairs that `make` finds among the rows with one token, from the larger node to the smaller."""

        def propose(batches):
            tokens = unpack([bytes(x) for pdf in batches for x in pdf["data"]], _TOKENS)
            waiting, count = [], 0
            for pairs in make(tokens, share):
                waiting.append(pairs)
                count += len(pairs)
                if count > 1 << 20:
                    yield _table(np.concatenate(waiting))
                    waiting, count = [], 0
            if count:
                yield _table(np.concatenate(waiting))

        if known is None:
            labelled = nodes.withColumn("comp", F.col("id"))
        else:
            labelled = nodes.join(known.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
        sent = labelled.select("doc", "comp", "prefix", "n", "sketch").mapInPandas(spread, "part int, data binary, reply boolean")
        return sent.repartitionById(parts, F.col("part")).mapInPandas(propose, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))

    def judged(pairs: DataFrame, payload: str, each, check, label: str) -> DataFrame:
        """The written `pairs` that `check` accepts, by what `each` makes of the payload of their nodes."""
        n, each_bytes = pairs.count(), int(nodes.agg(F.avg(F.octet_length(payload))).first()[0] or 0)
        blocks = max(partitions(spark), -(-n // BLOCK_PAIRS), -(-2 * n * each_bytes // BLOCK_BYTES))
        many = pairs.groupBy("b").count().where(F.col("count") > BLOCK_PAIRS).select(F.col("b").alias("_b"), F.ceil(F.col("count") / BLOCK_PAIRS).alias("_cuts"))
        keyed = pairs.join(small(many), F.col("b") == F.col("_b"), "left")
        cut = F.pmod(F.xxhash64("a"), F.coalesce("_cuts", F.lit(1)))
        keyed = keyed.select(F.pmod(F.xxhash64("b", cut), F.lit(blocks)).alias("key"), "a", "b")
        # each side's nodes are collapsed in its tasks before they meet, so a dense group sends nodes, not pairs
        needed = keyed.select("key", F.col("a").alias("node")).distinct().union(keyed.select("key", "b").distinct()).distinct()
        held = nodes.select(F.col("doc").alias("node"), F.col(payload).alias("data"))
        held = held.join(small(needed.select("node").distinct()), "node", "left_semi")
        needed = needed.join(held, "node").select((F.col("key") + 0).alias("at"), "node", "data")

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            own = dict(zip(right["node"], each([bytes(x) for x in right["data"]]), strict=True))
            ok = [check(own[a], own[b]) for a, b in zip(left["a"], left["b"], strict=True)]
            return left.loc[np.array(ok, bool), ["a", "b"]]

        return written(keyed.groupBy("key").cogroup(needed.groupBy("at")).applyInPandas(compare, "a long, b long"), label)

    def agreed(pairs: DataFrame) -> DataFrame:
        """Those of the written `pairs` whose prefixes meet under all orders, as far as marks tell."""
        out = judged(pairs, "marks", lambda x: [_spelled_marks(m) for m in x], lambda a, b: agree(a, b, percent), "jaccard-agreed")
        discard(spark, pairs)
        return out

    def links(pairs: DataFrame) -> DataFrame:
        """The links among the written `pairs`, by their whole sets."""
        return judged(pairs, "text", lambda x: sets_in(plain(x)), lambda a, b: linked(a, b, percent), "jaccard-links")

    def grown(known: DataFrame, more: DataFrame) -> DataFrame:
        return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    # first each class against those with which it shares most tokens, then all that are still apart
    first = proposed(None, _sample).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), asc=False), 1, FIRST_PAIRS).alias("all"))
    close = agreed(written(first.select("a", F.explode("all.b").alias("b")), "jaccard-first"))
    known = components(links(close))
    apart = agreed(written(proposed(known, _pairs).select("a", "b"), "jaccard-apart"))
    if apart.limit(1).count():
        # of these, each node's pair with one smaller and one larger node (by hash) joins most of a dense group
        by = F.xxhash64("a", "b")
        tree = apart.groupBy("a").agg(F.min_by("b", by).alias("b")).union(apart.groupBy("b").agg(F.min_by("a", by).alias("a")).select("a", "b"))
        tree = written(tree.distinct(), "jaccard-tree")
        known = grown(known, links(tree))
        # every other pair whose nodes are still in different components
        ends = [known.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in "ab"]
        rest = apart.join(tree, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        rest = written(rest.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"), "jaccard-rest")
        more = links(rest)
        if more.limit(1).count():
            known = grown(known, more)
        discard(spark, tree, rest)
    discard(spark, close, apart)
    reps = rows.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "t")).alias("rep"))
    named = known.join(nodes.select(F.col("doc").alias("node"), "d1"), "node").select("d1", "component")
    inside = written(reps.join(small(named), "d1"), "jaccard-inside")
    discard(spark, nodes)
    least = written(inside.groupBy("component").agg(F.min("rep").alias("least")), "jaccard-least")
    inside = inside.join(small(least), "component").select("d1", "d2", "least")
    by_class = written(reps.join(inside.hint("shuffle_hash"), ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "rep").alias("least")), "jaccard-groups")
    out = rows.where("n > 0").join(by_class, ["d1", "d2"]).select("doc", "t", "n", "least")
    out = out.union(rows.where("n = 0").select("doc", "t", "n", F.struct("doc", "t")))
    kept = (F.col("doc") == F.col("least.doc")) & (F.col("t") == F.col("least.t"))
    known_id = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    out = out.select("doc", "t", "n", F.col("least.doc").alias("least"), kept.alias("kept"))
    return out.select(known_id("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known_id("least").alias("component_id"), "doc", "t", "kept")


def _table(pairs: np.ndarray) -> pd.DataFrame:
    ends, at = np.unique(pairs[:, :2], axis=0, return_inverse=True)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "shared": np.bincount(at, pairs[:, 2], len(ends)).astype(np.int64)})


def op8(spark, sf_dir: str) -> DataFrame:
    return similar_groups(load(spark, sf_dir, "documents"), size=3, percent=90)


OP8_SQL = r"""
WITH RECURSIVE listed AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b.y, r.root FROM reached r JOIN both_ways b ON b.x = r.doc_id)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c.root, l.doc_id) AS component_id FROM listed l LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM reached GROUP BY doc_id) c USING (doc_id)
"""
