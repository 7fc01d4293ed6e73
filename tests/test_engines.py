"""Queries against their SQL on few rows of large keys, where places are equally far, and plans that must not gather tables or repeat work."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from solaraddr.operators import compiled as C
from solaraddr.operators import headers as H
from solaraddr.operators import locate as L
from solaraddr.plans import driver


def both(spark, folder, query, parts, events):
    """Rows of a query and of its SQL over parts and events with these keys."""
    one = lambda keys, name: spark.createDataFrame([(k,) for k in keys], f"{name} long")
    for name, df in (("part", one(parts, "p_partkey")), ("events", one(events, "event_id"))):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    got = entry.queries()[query](spark, str(folder))
    with duckdb.connect() as con:
        for name in ("part", "events"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[query]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


@pytest.mark.parametrize(
    ("query", "parts", "events"),
    [
        ("nearest_rows_topk", [*range(1176, 1206), *range(940, 970), *range(720, 750)], [105750, 120750, 122250]),
        ("locate_best", [1091, 1103, 683, 695, 1955, 1967], [12750, 149250, 194250]),
        ("locate_candidates", range(1176, 1206), [105750]),
        ("locate_repeated_ids", [*range(736, 764), *range(64, 92)], [108750, 113250]),
    ],
)
def test_equally_far_rows_rank_as_in_sql(spark, tmp_path, query, parts, events):
    """These fixes lie on the road, as far from a row in the north as from one in the south."""
    got, want = both(spark, tmp_path, query, parts, events)
    assert got == want and len({r[0] for r in got}) == len(events)


def test_cells_are_not_broadcast(spark, tmp_path):
    """The planner takes cells for small, as it does not see that rows are listed in several."""
    fixes = spark.range(10).select(F.col("id").alias("fix_id"), (F.lit(-27.4) + F.col("id") * 1e-6).alias("lat"), (F.lit(152.7) + F.col("id") * 1e-6).alias("lon"), F.lit(1.0).alias("accuracy"))
    spark.range(10).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = driver.tracker_rows(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = L.rows_in_range(fixes, C.compile_rows(rows, driver.FARM), driver.FARM)
    assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_the_words_of_a_header_are_computed_once(spark):
    """They were written out at each use, inside of each other's functions."""
    df = spark.createDataFrame([("Y_Norte",)], "h string").select(H.coordinate_role(F.col("h")).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1 and df.first().r == "start_y"


def test_candidates_are_sorted_once(spark, tmp_path):
    """Each window over the candidates of a fix had a sort of its own."""
    fixes = spark.range(10).select(F.col("id").alias("fix_id"), (F.lit(-27.4) + F.col("id") * 1e-6).alias("lat"), (F.lit(152.7) + F.col("id") * 1e-6).alias("lon"), F.lit(1.0).alias("accuracy"))
    spark.range(10).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    near = L.near_rows(fixes, driver.tracker_rows(spark, str(tmp_path)), driver.FARM)
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("- Sort [")
    assert sorts(L.credible_range(L.candidates(near, driver.FARM))) == sorts(near) + 1
