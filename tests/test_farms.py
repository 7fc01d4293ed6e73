"""Many farms in one plan, generated rows, the adaptive grid, and warnings as records."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from solaraddr.functions.layout import Layout
from solaraddr.operators import compiled as C
from solaraddr.operators import farms as M
from solaraddr.operators import grid as G
from solaraddr.operators import locate as L
from solaraddr.operators import synthetic as Y

PROFILES = [
    {"id": "a", "name": "A", "profileVersion": 1, "module": {"widthMm": 1130.0, "gapMm": 20.0, "pitchMm": None}, "topology": {"modulesPerString": 28, "stringsPerRow": 2, "stringGapMm": 3713.0},
     "geometry": {"endpointOffsetMm": -1464.0, "endpointOffsetMode": "both"}, "addressing": {"originStrategy": "dc-box-end", "dcBoxPlacement": "center-road", "inversionStrategy": "piercing-chain"}},
    {"id": "b", "name": "B", "profileVersion": 1, "module": {"widthMm": 2280.0, "gapMm": 25.0, "pitchMm": None}, "topology": {"modulesPerString": 30, "stringsPerRow": 1},
     "geometry": {"endpointOffsetMm": 0.0, "endpointOffsetMode": "none"}, "addressing": {"originStrategy": "fixed-end", "fixedEnd": "north", "inversionStrategy": "none"}, "matching": {"maxDistanceM": 20.0, "neighborhood": 1, "defaultAccuracyM": 1.0}},
    {"id": "c", "name": "C", "profileVersion": 1, "module": {"widthMm": 2000.0, "gapMm": 20.0, "pitchMm": "derive"}, "topology": {"modulesPerString": 14, "stringsPerRow": 2, "stringGapMm": 1000.0},
     "geometry": {"endpointOffsetMm": 0.0, "endpointOffsetMode": "none"}, "addressing": {"originStrategy": "per-row-flag", "inversionStrategy": "per-string-flag"}, "matching": {"maxDistanceM": 25.0, "maxRowCandidates": 2}},
]
PLACES = {"a": (-27.4, 152.7), "b": (10.0, 20.0), "c": (51.0, -3.0)}
SINGLE = {
    "a": C.Farm(*PLACES["a"]),
    "b": C.Farm(*PLACES["b"], Layout(30, 1, 2.28, 0.025, 0.0, 0.0), 20.0, 1, 3, 1.0, origin="fixed-end", fixed_end="north", inversion="none", offset_mode="none"),
    "c": C.Farm(*PLACES["c"], Layout(14, 2, 2.0, 0.02, 1.0, 0.0), 25.0, 2, 2, 3.0, origin="per-row-flag", inversion="per-string-flag", offset_mode="none", pitch="derive"),
}
ROW = "farm_id string, row_ord long, row_id string, lat_a double, lon_a double, azimuth double, side string, pos double, pos_total double, origin_flag string, string_inverted array<boolean>"


@pytest.fixture(scope="module")
def batch(spark):
    """Profiles, rows that are built to them, origins, and every slot of every row as a fix put aside by up to 40 cm."""
    profiles = spark.createDataFrame(PROFILES, M.PROFILE)
    anchors = [
        (f, i, f"r{i}", lat + 0.003 * (i // 4), lon + 0.003 * (i % 4), 20.0 + 97 * i, ("north", "south")[i % 2], float(i % 3 + 1), 3.0, ("start", "end", None)[i % 3], [False, bool(i % 2)])
        for f, (lat, lon) in PLACES.items() for i in range(8)
    ]
    origins = spark.createDataFrame([(f, *x) for f, x in PLACES.items()], "farm_id string, lat double, lon double")
    farms = M.Farms.of(M.parameters(profiles, origins))
    rows = Y.planted_rows(spark.createDataFrame(anchors, ROW), farms).cache()
    made = Y.slots(rows, farms, aside=(F.col("slot") % 5 - 2) * F.lit(0.2))
    fixes = made.select("farm_id", F.expr("row_ord * 100 + slot").alias("fix_id"), "slot", "lat", "lon", F.when(F.col("slot") % 2 == 0, 0.5).alias("accuracy")).cache()
    return profiles, rows, origins, fixes


def test_three_farms_at_once_are_three_runs(spark, batch):
    profiles, rows, origins, fixes = batch
    farms, compiled = M.compile_farms(profiles, rows, origins)
    found = L.candidates(L.near_compiled(fixes, compiled, farms), farms)
    columns = ["fix_id", "row_id", "position", "module", "string_number", "counted_from", "rank"]
    for f, farm in SINGLE.items():
        mine = rows.where(F.col("farm_id") == f).drop("farm_id")
        alone = L.locate(fixes.where(F.col("farm_id") == f).drop("farm_id"), mine, farm)
        want = {tuple(r) for r in alone.select(*columns, F.round("confidence", 9)).collect()}
        got = {tuple(r) for r in found.where(F.col("farm_id") == f).select(*columns, F.round("confidence", 9)).collect()}
        assert got == want and len(want) > 500
    some = L.warnings(found).join(L.warning_records(found, farms), ["farm_id", "fix_id"])
    assert some.where(F.col("codes") != F.array_join("warnings.code", ",")).count() == 0 and some.count() == fixes.count()
    assert L.without_rows(fixes, rows, farms).count() == 0 and L.credible_range(found).count() == fixes.count()


def test_every_slot_of_every_row_is_found_again(batch):
    profiles, rows, origins, fixes = batch
    farms, compiled = M.compile_farms(profiles, rows, origins)
    best = L.best_modules(L.near_compiled(fixes, compiled, farms), farms)
    total = F.when(F.col("farm_id") == "b", 30).when(F.col("farm_id") == "c", 28).otherwise(56)
    right = best.withColumn("want", F.when(F.col("origin_end") == "start", F.col("slot")).otherwise(total + 1 - F.col("slot")))
    assert right.count() == 8 * (56 + 30 + 28)
    assert right.where("position <> want OR abs(module_distance - abs(slot % 5 - 2) * 0.2) > 0.02").count() == 0


def test_generated_rows_have_the_stated_length(spark, batch):
    """65.145 m and 69.125 m are what the two farms' documents state."""
    _, rows, _, _ = batch
    length = {r.farm_id: r.m for r in rows.groupBy("farm_id").agg(F.max(F.hypot((F.col("lat_b") - F.col("lat_a")) * 111000, (F.col("lon_b") - F.col("lon_a")) * 111000 * F.cos(F.radians("lat_a")))).alias("m")).collect()}
    assert length["a"] == pytest.approx(65.145, rel=0.01) and length["b"] == pytest.approx(69.125, rel=0.01)
    one = spark.range(1).select(*[Y.nominal_length(f).alias(k) for k, f in SINGLE.items()]).first()
    assert one.a == pytest.approx(65.145) and one.b == pytest.approx(69.125)


def test_wrong_profiles_raise_with_all_issues(spark, batch):
    _, rows, _, _ = batch
    bad = [{**PROFILES[0], "name": " ", "topology": {"modulesPerString": 0, "stringsPerRow": 2}}, PROFILES[1], PROFILES[1], {**PROFILES[2], "id": "d"}]
    with pytest.raises(M.ProfileError) as error:
        M.compile_farms(spark.createDataFrame(bad, M.PROFILE), rows)
    assert set(error.value.issues) == {("a", "name"), ("a", "topology.modulesPerString"), ("b", "id is given twice"), ("d", "no rows"), ("c", "rows without a profile")}
    farms, compiled = M.compile_farms(spark.createDataFrame(bad, M.PROFILE), rows, strict=False)
    assert {r.farm_id for r in compiled.select("farm_id").distinct().collect()} == {"b"}


def test_the_plane_is_around_the_rows_unless_it_is_given(spark, batch):
    profiles, rows, _, fixes = batch
    farms, compiled = M.compile_farms(profiles, rows)
    middle = {r.farm_id: (r.lat, r.lon) for r in M.middles(rows).collect()}
    assert {r.farm_id: (r.farm_lat, r.farm_lon) for r in farms.parameters.collect()} == middle
    assert L.best_modules(L.near_compiled(fixes, compiled, farms), farms).count() == fixes.count()


def crowd(spark, n=6000):
    """Nine fixes in ten within 30 m, a third of those at one place."""
    k = F.col("id")
    lon = F.when(k % 10 < 9, F.when(k % 3 == 0, 0.0001).otherwise((k * 7919 % 300) * 1e-6)).otherwise((k * 7919 % 9000) * 1e-6)
    return spark.range(n).select(k.alias("fix_id"), (F.lit(-27.4) - (k * 104729 % 600) * 1e-6 * F.when(k % 3 == 0, 0).otherwise(1)).alias("lat"), (lon + 152.7).alias("lon"), F.lit(None).cast("double").alias("accuracy"))


@pytest.mark.parametrize("distance", [5.0, 30.0, 900.0])
def test_the_adaptive_grid_gives_the_same_pairs(spark, distance):
    farm = replace(SINGLE["a"], max_distance=distance)
    k = F.col("id")
    rows = spark.range(60).select(k.alias("row_ord"), F.concat(F.lit("r"), k).alias("row_id"), F.lit(-27.4).alias("lat_a"), (F.lit(152.7) + k * 0.00015).alias("lon_a"), F.lit(-27.4006).alias("lat_b"), (F.lit(152.7) + k * 0.00016).alias("lon_b"))
    compiled, fixes = C.compile_rows(rows, farm), crowd(spark)
    want = {tuple(r) for r in L.rows_in_range(fixes, compiled, farm).select("fix_id", "row_id", F.round("distance", 6)).collect()}
    got = [tuple(r) for r in G.adaptive_rows_in_range(fixes, compiled, farm, least=100).select("fix_id", "row_id", F.round("distance", 6)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    cells = G.Cells(fixes, compiled.select("row_id", *L._BOUNDS), farm, 100)
    held = cells.fixes.groupBy("level", "qx", "qy", "part").count()
    # parts of one place are dealt by hash, so they are even only about
    assert cells.fixes.count() == 6000 and held.agg(F.max("count")).first()[0] <= 150


def test_the_adaptive_grid_over_farms_and_nothing(spark, batch):
    profiles, rows, origins, fixes = batch
    farms, compiled = M.compile_farms(profiles, rows, origins)
    pairs = lambda f: {tuple(r) for r in f.select("farm_id", "fix_id", "row_id").collect()}
    assert pairs(G.adaptive_rows_in_range(fixes, compiled, farms, least=20)) == pairs(L.rows_in_range(fixes, compiled, farms))
    assert G.adaptive_rows_in_range(fixes.limit(0), compiled, farms).count() == 0


def test_ids_that_repeat_keep_the_nearest_rows_position(spark):
    """W-11: of two rows of one id the nearer one keeps a position that both have."""
    farm = C.Farm(-27.4, 152.7, accuracy=0.5, origin="fixed-end", fixed_end="north", inversion="none")
    rows = spark.createDataFrame([(i, "same", -27.4, 152.7 + 0.00005 * i, -27.400588, 152.7 + 0.00005 * i) for i in range(2)], "row_ord long, row_id string, lat_a double, lon_a double, lat_b double, lon_b double")
    fixes = spark.createDataFrame([(1, -27.4003, 152.70001, None)], "fix_id long, lat double, lon double, accuracy double")
    found = L.locate(fixes, rows, farm)
    assert found.select("position").distinct().count() == found.count() and {r.row_ord for r in found.collect()} == {0}


def test_lengths_of_a_fix_on_a_module_edge(spark, tmp_path):
    """Fix 2811200 lies at the first module's edge of row s997, where a length that is off in its last place tells another position."""
    from solaraddr.plans.reports import QUERIES

    spark.range(4000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2811200, 2811201).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.codes for r in QUERIES["slanted_warnings"](spark, str(tmp_path)).collect()] == ["missing-flag,outside-row-extent"]
    assert ("outside-row-extent", "s997", 1000) in [(r.code, r.row_id, r.raw_mille) for r in QUERIES["warning_details"](spark, str(tmp_path)).collect()]


def test_slot_round_trip_broadcasts_nothing(spark, tmp_path, capsys):
    """The cells of its rows are shuffled, not gathered on the driver."""
    from solaraddr.plans.reports import QUERIES

    spark.range(100).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["slot_round_trip"](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
