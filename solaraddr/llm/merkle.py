"""A Merkle tree over documents: authentication paths by traversal scheduling in aligned blocks, shared upper paths joined to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import batch_of, placed, runs
from .tables import ascii_lower, crc32_sql, load, written

#: Children of a node, and levels of a block: a task holds FAN ** HEIGHT digests at a time.
FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one output batch.
BATCH = 4096

_NODE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_PATH = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
_SQL = {_NODE: "tree string, place long, n long, digest string", _PATH: "tree string, place long, path string, subroot string, root string"}
_PROOF_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above the nodes of one block of a tree of n nodes: as many as lead to one node, or HEIGHT where there are more blocks."""
    return next((h for h in range(HEIGHT) if FAN**h >= n), HEIGHT)


class Treehash:
    """Nodes of one level over leaves that come one by one; the stacks hold fewer than FAN nodes of each level below."""

    def __init__(self, height: int):
        self.stacks: list[list[str]] = [[] for _ in range(height + 1)]

    def feed(self, node: str) -> None:
        self.stacks[0].append(node)
        for low, high in zip(self.stacks, self.stacks[1:]):
            if len(low) < FAN:
                return
            high.append(digest(low))
            low.clear()

    def close(self) -> list[str]:
        """The nodes; what is left below makes shorter runs."""
        for low, high in zip(self.stacks, self.stacks[1:]):
            if low:
                high.append(digest(low))
                low.clear()
        return self.stacks[-1]


def traverse(leaves: list[str], height: int) -> Iterator[list[str]]:
    """For each leaf in turn its path in the block: for each level the siblings as hex text, with `*` where the node itself stands.

    Each level keeps the run that it is in, and a stack for the next run that takes one leaf a step and so is ready when that run begins.
    """
    spans = [FAN ** (h + 1) for h in range(height)]
    ahead = [Treehash(h) for h in range(height)]
    for stack, span in zip(ahead, spans):
        for leaf in leaves[:span]:
            stack.feed(leaf)
    run: list[list[str]] = [[]] * height
    path = [""] * height
    for i in range(len(leaves)):
        for h, span in enumerate(spans):
            if i % span == 0:
                run[h], ahead[h] = ahead[h].close(), Treehash(h)
            if i + span < len(leaves):
                ahead[h].feed(leaves[i + span])
            if i % (span // FAN) == 0:
                k = i // (span // FAN) % FAN
                path[h] = "".join(run[h][:k]) + "*" + "".join(run[h][k + 1 :])
        yield path


def folded(node: str, path: list[str]) -> str:
    """The root that a leaf gives with the siblings of its path."""
    for level in path:
        left, _, right = level.partition("*")
        node = digest((left, node, right))
    return node


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, place, n, digest) in this order -> the node above each block."""
    out = []
    for (tree, block), rows in runs(batches, 2):
        stack = Treehash(height_of(rows[0][3]))
        for row in rows:
            stack.feed(row[4])
        out.append((tree, block, -(-rows[0][3] // BLOCK), stack.close()[0]))
        if len(out) == BATCH:
            yield batch_of(_NODE, out)
            out = []
    yield batch_of(_NODE, out)


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema, finish: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, place, n, digest, ...), before each block a row with place -1 and the path above it, its subroot and root."""
    out = []
    for _, (above, *rows) in runs(batches, 2):
        upper, subroot, root = above[-3:]
        upper = upper.split(",") if upper else []
        for row, path in zip(rows, traverse([r[4] for r in rows], height_of(rows[0][3]))):
            out.append(finish(row, path, upper, subroot, root))
            if len(out) == BATCH:
                yield batch_of(schema, out)
                out = []
    yield batch_of(schema, out)


def _path(row: tuple, path: list[str], upper: list[str], subroot: str, root: str) -> tuple:
    return row[0], row[2], ",".join([*path, *upper]), subroot, root


def _proof(row: tuple, path: list[str], upper: list[str], subroot: str, root: str) -> tuple:
    doc_id, tampered = row[5:7]
    path = [*path, *upper]
    end = folded(tampered or row[4], path)
    return doc_id, row[4], subroot, root, digest(x.replace("*", "") for x in path), end, end == root


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK)).select("tree", "block", "place", "n", "digest", *[c for c in nodes.columns if c not in ("tree", "place", "n", "digest")])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _above(nodes: DataFrame) -> DataFrame:
    return written(_dealt(_blocks(nodes).select("tree", "block", "place", "n", "digest")).mapInArrow(_tops, _SQL[_NODE]), "merkle-nodes")


def _below(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes by block, each block headed by the path of the node above it."""
    heads = upper.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path", "subroot", "root")
    return _dealt(_blocks(nodes).unionByName(heads, allowMissingColumns=True))


def paths(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tree, place, n, digest) -> (tree, place, path, subroot, root). `crown` gives these for trees that have come down to one node."""
    if not nodes.where("n > 1").limit(1).count():
        return crown(nodes)
    upper = paths(_above(nodes), crown)
    return written(_below(nodes, upper).mapInArrow(lambda b: _walk(b, _PATH, _path), _SQL[_PATH]), "merkle-paths")


def over_sources(subroots: DataFrame) -> DataFrame:
    """The paths from the subroots, ordered by their trees' names, to the root over them."""
    ranked = written(placed(subroots.select("tree", "digest"), [], ["tree"], "merkle-sources"), "merkle-ranks")
    alone = lambda x: x.select("tree", "place", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    top = paths(ranked.select(F.lit(None).cast("string").alias("tree"), "place", "n", "digest"), alone)
    return ranked.join(top.select("place", "path", "root"), "place").select("tree", F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root")


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents with this text: each field as byte count, colon and value, or a dash."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def manifest(documents: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of documents (doc_id, source, lang, n_chars, text).

    Where `tampered` holds, the leaf that is folded is that of the text `changed`; its siblings are the original ones. Rows of a
    source go by doc_id (null first), those of one doc_id by their leaf, so repeated rows are leaves of their own with equal
    digests. A null source is a tree of its own, before all others. Null and empty texts are different leaves; a text of any
    length is hashed by Spark before anything moves. Other columns are ignored; an empty table gives no rows.

    Trees grow by blocks of FAN ** HEIGHT nodes, however large a source is: blocks become nodes of the next round, and paths
    come down the same rounds. What moves is a digest or two a document and one path a block.
    """
    text = F.col("text")
    rows = documents.select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(text).alias("digest"), F.when(tampered, leaf_of(changed)).alias("tampered"))
    leaves = placed(written(rows, "merkle-leaves"), ["tree"], ["doc_id", "digest"], "merkle-order")
    leaves = written(leaves.select("tree", "place", "n", "digest", "doc_id", "tampered"), "merkle-places")
    upper = paths(_above(leaves), over_sources)
    return _below(leaves, upper).mapInArrow(lambda b: _walk(b, _PROOF, _proof), _PROOF_SQL)


def op13(spark, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(load(spark, sf_dir, "documents"), fifth, ascii_lower(F.col("text")))


def _sql(levels: int = 6) -> str:
    """SQL for the same rows, for trees of up to FAN ** levels nodes."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else f'CAST({c} AS VARCHAR)') for c in FIELDS)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"leaves AS (SELECT doc_id, source AS tree, {leaf('text')} AS h, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents)"]

    def tree(name: str, nodes: str) -> None:
        """The levels of a tree, each node with its siblings to the left and right."""
        out.append(f"{name}0 AS MATERIALIZED ({nodes})")
        for k in range(levels):
            own = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
            out.append(
                f"{name}s{k} AS (SELECT tree, place, n, coalesce(string_agg(h, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"
            )
            out.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, place // 16 AS place, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h "
                f"FROM {name}{k} GROUP BY tree, place // 16, n)"
            )

    def climb(name: str, steps: str, start: str) -> None:
        """Proof and folded node, level by level."""
        out.append(f"{name}0 AS ({start})")
        for k in range(levels):
            out.append(
                f"{name}{k + 1} AS (SELECT d.* REPLACE (proof || coalesce(l || r, '') AS proof, CASE WHEN l IS NULL THEN fold ELSE sha256(l || fold || r) END AS fold) "
                f"FROM {name}{k} d LEFT JOIN {steps}{k} s ON s.tree IS NOT DISTINCT FROM d.tree AND s.place = d.place // {FAN**k})"
            )

    tree("t", "SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves")
    tree("u", f"SELECT 0 AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t{levels}")
    climb("d", "ts", "SELECT doc_id, tree, place, h, '' AS proof, coalesce(tampered, h) AS fold FROM t0")
    climb("e", "us", f"SELECT doc_id, 0 AS tree, u.place, d.h, proof, fold, u.h AS subroot FROM d{levels} d JOIN u0 u ON d.tree IS NOT DISTINCT FROM u.source")
    return (
        f"WITH {', '.join(out)} SELECT doc_id, e.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified "
        f"FROM e{levels} e, u{levels} r"
    )


OP13_SQL = _sql()
