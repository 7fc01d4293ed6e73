"""Stages of the pipeline on repeated rows, null ids, several texts under one id and planted leaks."""

import corpus_pipeline
from test_repeats import cut, linked_rows, several_texts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def plain(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))


def test_drop_similar_keeps_one_of_each_group(spark):
    rows = several_texts()
    # a near copy without an id beside a leader without one, and a copy under an id that leads another group
    rows += [(None, rows[0][1] + " more"), (7, rows[1][1] + " more")]
    _, group = linked_rows(rows, 5, 80)
    got = plain(corpus_pipeline.drop_similar(spark, documents(spark, rows), ""))
    key = lambda i: -1 if i is None else i
    lead = {}
    for (i, t), g in zip(rows, group, strict=True):
        if t:
            lead.setdefault(g, []).append((key(i), t))
    # which of several texts under a group's least id leads is open
    worded = [(-1 if null else i, t) for null, i, t in got if t]
    assert len(worded) == len(lead)
    for members in lead.values():
        least = min(members)[0]
        assert sum(x in worded for x in {m for m in members if m[0] == least}) == 1
    assert [x for x in got if not x[2]] == [(False, 50, ""), (False, 51, "")]


def test_cut_repeats(spark):
    rows = [(8, words(0, 60)), (8, words(0, 60)), (9, f"a {words(0, 60)} b"), (None, words(200, 240)), (None, words(200, 240))]
    got = plain(corpus_pipeline.cut_repeats(spark, documents(spark, rows), ""))
    assert got == sorted((i is None, i or 0, t) for i, _, _, t in cut(rows))


def test_drop_leaks(spark, tmp_path):
    item = words(0, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{words(50, 90)} {item} x"), (2, words(50, 90)), (2, words(50, 90)), (None, item), (None, words(90, 95)), (3, None)]
    got = plain(corpus_pipeline.drop_leaks(spark, documents(spark, rows), str(tmp_path)))
    assert got == sorted([(False, 2, rows[1][1]), (False, 2, rows[1][1]), (True, 0, rows[4][1]), (False, 3, "")])


def test_drop_toxic(spark, tmp_path):
    rows = [(i, f"word{i % 17} some plain text word{i % 13} and more" + (f" you vile{i % 3} scum" if i % 3 == 0 else "")) for i in range(120)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.drop_toxic(spark, documents(spark, [*rows, (None, None), (1, rows[1][1])]), str(tmp_path)).collect()
    kept = [r.doc_id for r in got]
    assert kept.count(1) == 2 and None in kept and sum(i is not None and i % 3 == 0 for i in kept) <= 2 and sum(i is not None and i % 3 > 0 for i in kept) >= 80


def test_stages_carry_other_columns(spark, tmp_path):
    """Columns that stages use inside, a map, a column with a dot; an empty table."""
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(0, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = ["kept", "whole", "cut", "_s", "copies", "score", "predicted", "spans", "leaks", "doc", "t", "_doc", "blobs", "extra0"]
    docs = documents(spark, [(1, words(100, 160)), (1, words(100, 160)), (2, words(200, 260)), (None, None)])
    docs = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in clash], "map('a', 1) AS m", "5 AS `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in clash if c != "copies") and all(r["a.b"] == 5 and r["m"] == {"a": 1} for r in rows)
        assert (out.columns[len(docs.columns) :] == ["copies_"]) == (name == "mixing")
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0


def test_run_on_planted_cases(spark, tmp_path):
    """The whole pipeline: a toxic text, copies, a near copy, a shared passage and a leaked item go, clean texts stay."""
    clean = [(i, words(1000 * i, 1000 * i + 90)) for i in range(1, 40)]
    toxic = [(100 + i, f"{words(60_000 + i, 60_009 + i)} you vile{i % 3} scum") for i in range(30)]
    passage, item = words(90_000, 90_060), words(95_000, 95_030)
    rows = [*clean, *toxic, (201, clean[0][1]), (202, clean[1][1] + " more"), (203, f"{words(80_000, 80_040)} {passage}"), (204, f"{passage} {words(81_000, 81_040)}"), (205, f"{words(82_000, 82_040)} {item}")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 200)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in clean} <= set(got) and not set(got) & {201, 202, 205}
    assert sum(100 <= i < 200 for i in got) <= 2
    assert got[203].endswith(passage) and got[204] == words(81_000, 81_040)
