"""Repeated rows, null ids and several texts under one id, against brute force."""

import hashlib

import numpy as np
import pytest

from solaraddr.llm import components, jaccard, substrings
from solaraddr.llm.substrings import FIELDS, dedup_substrings

SCHEMA = "doc_id long, text string"


def words(begin, end):
    return " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(begin, end))


def cut(rows, width=20):
    """What dedup_substrings returns, row by row: places are (id, place, text), null ids before all others."""
    least = {}
    key = lambda i: -(1 << 63) if i is None else i
    windows = lambda t: (((s, tuple(w[s : s + width])) for s in range(len(w) - width + 1)) for w in [(t or "").split()])
    for i, t in rows:
        for s, w in next(windows(t)):
            place = (key(i), s)
            least[w] = min(least.get(w, (place, t or "")), (place, t or ""))
    out = []
    for i, t in rows:
        own = (t or "").split()
        gone = [False] * len(own)
        for s, w in next(windows(t)):
            if least[w] != ((key(i), s), t or ""):
                gone[s : s + width] = [True] * width
        out.append((i, len(own), sum(gone), " ".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_keep_their_text(spark, parts):
    shared = words(100, 130)
    rows = [(8, words(0, 60)), (8, words(0, 60)), (9, f"a {words(0, 60)} b"), (None, words(200, 240)), (None, words(200, 240)), (None, words(300, 340))]
    rows += [(11, f"{shared} {words(400, 430)}"), (11, f"{shared} {words(400, 430)}"), (12, f"x {shared}"), (13, f"{shared} {shared}"), (13, f"{shared} {shared}")]
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=order) == sorted(cut(rows), key=order)


def test_a_place_is_not_earlier_than_itself():
    r = np.zeros(4, FIELDS["window"])
    r["h"], r["doc"], r["at"] = 5, [1, 1, 2, 2], 3
    first, later = substrings._judged(r)
    assert first.tolist() == [True, False, False, False] and later.tolist() == [False, False, True, True]


def linked_rows(rows, size, percent):
    """(id, shingles, group number) of each row: rows are the nodes, whatever their ids."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    return sets, group


def several_texts():
    """Null ids, two texts under one id, repeated rows and wordless rows; near copies differ in the last word."""
    texts = [words(1000 * k, 1000 * k + 80) for k in range(8)]
    near = lambda k: f"{texts[k]} other{k}"
    rows = [(None, t) for t in texts[:4]] + [(20 + k, near(k)) for k in range(4)]
    rows += [(7, texts[4]), (7, texts[5]), (7, texts[6]), (34, near(4)), (35, near(5)), (36, near(6)), (34, near(4))]
    return [*rows, (5, texts[7]), (5, texts[7]), (40, near(7)), (50, ""), (50, ""), (51, None)]


def test_texts_under_one_id_link_apart(spark):
    rows = several_texts()
    sets, group = linked_rows(rows, 5, 80)
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), len(s), min(key(rows[j][0]) for j in range(len(rows)) if group[j] == g)) for (i, _), s, g in zip(rows, sets, group, strict=True))
    got = jaccard.similar_groups(spark.createDataFrame(rows, SCHEMA), size=5, percent=80).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == want


def test_few_links_are_no_work_for_many_tasks(spark, monkeypatch):
    """Rounds over few links take a fraction of the tasks of those that are dealt out by key, and find the same."""
    pairs = [(i, i + 1) for i in range(1000, 1012)] + [(5, k) for k in range(6, 30)] + [(k, 3 * k % 97) for k in range(40, 60)]
    links = spark.createDataFrame(pairs, "a long, b long").coalesce(2)
    store, conf = spark.sparkContext._jsc.sc().statusStore(), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)

    def run():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seen = max([-1, *(store.jobsList(None).apply(i).jobId() for i in range(store.jobsList(None).size()))])
        out = {r.node: r.component for r in components.components(links).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = [store.jobsList(None).apply(i) for i in range(store.jobsList(None).size())]
        return out, sum(j.numTasks() - j.numSkippedTasks() for j in jobs if j.jobId() > seen)

    spark.conf.set(conf, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        few, tasks = run()
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0, raising=False)
        dealt, more = run()
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    group = {n: n for p in pairs for n in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert few == dealt == group
    assert 3 * tasks < more, (tasks, more)
