"""op12 and op13 against plain Python, with blocks and buckets so small that every path is taken."""

from hashlib import md5, sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from solaraddr.llm import merkle, prefixes
from solaraddr.llm.tables import ascii_lower

CHATS = "conv_id long, turn long, role string, text string, doc string"


def conversations():
    rows = []
    say = lambda c, t, text, role="user": rows.append((c, t, role, text, "clash"))
    for c in range(230):
        say(c, None if c % 17 == 0 else 0, "hello" if c % 3 else f"start {c % 5}")
        for t in range(1, c % 7):
            say(c, t, f"turn {t} {c % 2}", None if t % 2 else "assistant")
    for c in (301, 302, 303, 377):  # a long common prefix, copies, and one that ends inside of it
        for t in range(9 if c == 377 else 23):
            say(c, t, f"long {t}")
    say(303, 23, "one more")
    for t in range(20):  # long and alone, with ties, a null text and a repeated row
        say(-5, t // 2, None if t % 4 else "x" * t)
    say(500, 1, "same")
    say(500, 1, "same")
    rows.append((None, 0, "user", "no conversation", "clash"))
    say(90001, 1, "a" * 50000)
    return rows


def plain_trie(rows):
    by = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn, md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in by.items()}
    whole = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        head = c - int(c / 100) * 100
        whole[c] = own.get(c - head, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below, leaves, children = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below[p] = below.get(p, 0) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        leaves[p] = leaves.get(p, 0) or 1
        if p:
            up = p[:-1]
            below[up], leaves[up], children[up] = below.get(up, 0) + below[p], leaves.get(up, 0) + leaves[p], children.get(up, 0) + 1
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children.get(p, 0), leaves[p], below[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("local, chunk, piece", [(20_000, 512, 1 << 16), (6, 4, 30), (0, 3, 30)])
def test_trie(spark, monkeypatch, local, chunk, piece):
    monkeypatch.setattr(prefixes, "LOCAL", local)
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    rows = conversations()
    out = prefixes.trie(spark.createDataFrame(rows, CHATS))
    assert sorted(map(tuple, out.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefixes.trie(spark.createDataFrame([], CHATS)).count() == 0


def test_quicksort_of_a_long_chain():
    long = list(range(5000))
    nodes, top = prefixes.multikey_quicksort([(1, 2, long, long), (3, 1, long[:4000] + [9], long[:4000] + [9])], 0, 1)
    assert len(nodes) == 5001 and top[:2] == (1, 2) and nodes[-1][0] in (1, 3)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, place long, tree string"


def documents():
    rows = [(i, f"Text {i % 50} É", "en" if i % 3 else None, f"s{i % 2}" if i % 5 else "hot", i, 1, "clash") for i in range(700)]
    rows += [(1000, None, None, None, None, 1, "c"), (1001, "", "fr", None, 0, 1, "c"), (1002, "ABC " * 20000, "en", "long", 80000, 1, "c"), (None, "no id", "en", "hot", 5, 1, "c")]
    return [*rows, rows[3], rows[3], (3, "another text", "en", "s1", 1, 1, "c")]


def plain_manifest(rows):
    H = lambda *x: sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        """The top, and for each node its siblings (left, right) level by level."""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
                paths[i].append((run[: k % 16], run[k % 16 + 1 :]))
            nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
        return nodes[0], paths

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, s or ""))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in own[s]]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        for r, path in zip(own[s], trees[s][1]):
            end = leaf(r, low(r[1])) if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 else leaf(r, r[1])
            for left, right in path + above:
                end = H(*left, end, *right)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, H(*[x for left, right in path + above for x in left + right]), end, end == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16**height)
    rows = documents()
    for some in (rows, rows[:1], rows[:17]):
        df = spark.createDataFrame(some, DOCS)
        out = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text")))
        assert sorted(map(tuple, out.collect()), key=repr) == plain_manifest(some)


def test_manifest_of_many_sources(spark):
    rows = [(i, "t", "en", f"source {i}", 1, 1, "c") for i in range(300)]
    out = merkle.manifest(spark.createDataFrame(rows, DOCS), F.lit(False), F.col("text"))
    assert sorted(map(tuple, out.collect()), key=repr) == [(*r[:5], r[3], True) for r in plain_manifest(rows)]


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), F.lit(False), F.col("text")).count() == 0


def test_traversal_keeps_few_nodes():
    leaves = [merkle.digest([str(i)]) for i in range(16**3)]
    for i, path in enumerate(merkle.traverse(leaves, 3)):
        if i % 701 == 0:
            assert merkle.folded(leaves[i], path) == merkle.folded(leaves[0], next(merkle.traverse(leaves, 3)))
