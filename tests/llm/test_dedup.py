"""The dedup operators against brute force, on nulls, empty and long texts, copies and repeated rows."""

import hashlib
import time

import numpy as np

from solaraddr.llm.jaccard import similar_groups
from solaraddr.llm.substrings import dedup_substrings
from solaraddr.llm.suffixes import dedup_bytes


def test_substring_dedup(corpus):
    df, texts = corpus
    seen, want = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    rows = dedup_substrings(df).collect()
    assert len(rows) == len(texts) + 1
    assert all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept) for r in rows)


def test_byte_dedup(corpus):
    df, texts = corpus
    first, want = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), spans_of(gone), hashlib.sha256(kept).hexdigest())
    rows = dedup_bytes(df).collect()
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


def spans_of(gone):
    return sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))


def test_byte_dedup_of_null_and_repeated_ids(spark):
    """A null id is the smallest; texts under one id remove nothing from each other; a short common phrase removes nothing."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    filler = lambda n: "".join(rng.choice(letters, n))
    passage, phrase = filler(90), "this phrase has fewer than 50 bytes"
    rows = [(None, f"{passage} {filler(60)}"), (3, f"{filler(70)}{passage}{filler(80)}{passage[:60]}"), (3, f"{filler(30)}{passage}"), (4, filler(200)), (9, "")]
    rows += [(4, f"{filler(20)}{rows[1][1]}"), (8, None)] + [(100 + k, f"{filler(40)}{phrase}{filler(40)}") for k in range(40)]
    docs = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    want = []
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        want.append((i, len(b), sum(gone), spans_of(gone), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert max(w[3] for w in want) > 1


def test_similar_groups(corpus):
    df, _ = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, size=3, percent=90).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2)
    assert got[3] == got[9] == (1, 3)
    assert got[4] == (78, 0) and got[5][1] == 0
    assert got[8][1] == 8


def test_empty_tables(corpus):
    df, _ = corpus
    none = df.where("doc_id < 0")
    assert dedup_substrings(none).count() == dedup_bytes(none).count() == similar_groups(none).count() == 0


def test_dense_group_around_the_limit(spark):
    """Variants of one text whose similarities lie on both sides of the limit: components as by brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(160):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            w[at] = f"x{i}-{at}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in docs)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(docs))}
    assert 1 < len(set(want.values())) < len(docs)
    got = similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=3, percent=90)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_a_dense_group_is_joined_before_all_its_pairs_are_proposed(spark, monkeypatch):
    """Of 600 variants of one text, most are linked by the pairs that are looked at first; few of the 179700 pairs are left."""
    from solaraddr.llm import jaccard

    rng, made, written = np.random.default_rng(7), {}, jaccard.written

    def counted(df, name):
        out = written(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    docs = []
    for i in range(600):
        w = [f"w{k}" for k in range(120)]
        for at in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            w[at] = f"x{i}-{at}"
        docs.append((i, " ".join(w)))
    got = similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=3, percent=90).collect()
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in docs)]
    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    holds = np.zeros((600, len(place)), np.float32)
    for i, x in enumerate(sets):
        holds[i, [place[k] for k in x]] = 1
    both, n = holds @ holds.T, holds.sum(axis=1)
    near, least = 100 * both >= 90 * (n[:, None] + n - both), np.arange(600)
    while (least != (least := np.where(near, least, 600).min(axis=1))).any():
        pass
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(least.tolist()))
    assert made["jaccard-apart"][0] < 10000


def test_written_leaves_no_shuffle_files(spark):
    from solaraddr.llm.tables import CLEANUP, written

    files = lambda: [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]
    before, known = spark.conf.get(CLEANUP, None), set(files())
    table = written(spark.range(1000).repartition(4, "id").groupBy("id").count(), "cleaned")
    end = time.time() + 10
    while set(files()) - known and time.time() < end:
        time.sleep(0.2)
    assert not set(files()) - known and table.count() == 1000
    assert spark.conf.get(CLEANUP, None) == before
