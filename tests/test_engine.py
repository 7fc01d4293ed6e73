"""Rules, headers, string lists, sides, merges, photos, documents and profiles on small cases."""

import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from solaraddr.functions.geo import utm_to_wgs84, wgs84_to_utm
from solaraddr.functions.layout import Layout
from solaraddr.operators import compiled as C
from solaraddr.operators import headers as H
from solaraddr.operators import locate as L
from solaraddr.operators import merging as M
from solaraddr.operators import profiles as P
from solaraddr.operators import report as R
from solaraddr.operators import sides as D
from solaraddr.operators import strings as S
from solaraddr.operators import tables as T
from solaraddr.sources import documents as docs
from solaraddr.sources.photos import read_photos

ROWS = "row_ord long, row_id string, lat_a double, lon_a double, lat_b double, lon_b double, side string"


def farm_row(row_id, lat=-27.4, lon=152.7, rise=-0.0006, run=0.0, side=None, at=0):
    return (at, row_id, lat, lon, lat + rise, lon + run, side)


@pytest.mark.parametrize(("lat", "lon", "zone", "east", "north"), [(43.642567, -79.387139, 17, 630084, 4833439), (-33.8568, 151.2153, 56, 334900, 6252291)])
def test_utm_of_known_places(spark, lat, lon, zone, east, north):
    """The CN Tower and the Sydney Opera House, to a metre as published, and back to a hundred-millionth of a degree."""
    e, n, z, south = wgs84_to_utm(F.lit(lat), F.lit(lon))
    row = spark.range(1).select(e.alias("e"), n.alias("n"), z.alias("z"), south.alias("s")).first()
    assert row.z == zone and row.s == (lat < 0) and abs(row.e - east) < 15 and abs(row.n - north) < 15
    back = spark.range(1).select(*utm_to_wgs84(F.lit(row.e), F.lit(row.n), F.lit(zone), F.lit(row.s))).first()
    assert (back[0], back[1]) == pytest.approx((lat, lon), abs=1e-8)
    assert spark.range(1).select(utm_to_wgs84(F.lit(row.e), F.lit(row.n), F.lit(61), F.lit(True))[0]).first()[0] is None


def test_each_slot_of_a_slanted_row_is_found_again(spark):
    farm = C.Farm(-27.4, 152.7, Layout(14, 2, 2.0, 0.02, 1.0, 0.0), origin="fixed-end", fixed_end="west", inversion="none", offset_mode="none", pitch="derive")
    rows = spark.createDataFrame([farm_row("r", rise=-0.0005, run=0.0003)], ROWS)
    compiled = C.compile_rows(rows, farm)
    own = farm.layout.of_rows(F.col("pitch"), F.col("origin_offset"))
    d = own.distance_at(F.col("p"))
    at = F.when(F.col("origin_end") == "start", d).otherwise(F.col("length") - d)
    slots = spark.range(1, 29).withColumnRenamed("id", "p").withColumn("one", F.lit(1)).join(compiled.withColumn("one", F.lit(1)), "one")
    slots = slots.select("p", (F.col("ax") + F.col("ux") * at).alias("x"), (F.col("ay") + F.col("uy") * at).alias("y"))
    from solaraddr.functions.geo import to_geo

    lat, lon = to_geo(F.col("x"), F.col("y"), F.lit(farm.lat), F.lit(farm.lon))
    fixes = slots.select(F.col("p").alias("fix_id"), lat.alias("lat"), lon.alias("lon"), F.lit(0.2).alias("accuracy"))
    best = L.locate(fixes, rows, farm).where("rank = 1").collect()
    assert len(best) == 28 and all(r.fix_id == r.position and r.module_distance < 1e-6 for r in best)


def test_rows_without_length_or_room(spark):
    rows = spark.createDataFrame([farm_row("flat", rise=0.0), farm_row("short", rise=0.00001), farm_row("fine")], ROWS)
    farm = C.Farm(-27.4, 152.7, replace(Layout(), offset=2.0))
    assert {r.row_id: r.reason for r in C.compile_rows(rows, farm, strict=False).collect()} == {"flat": "zero-length", "short": "no-room", "fine": None}
    with pytest.raises(Exception, match="zero-length: flat"):
        C.compile_rows(rows.where("row_id = 'flat'"), farm).collect()
    with pytest.raises(ValueError, match="at least one row"):
        C.require_rows(rows.limit(0))


def test_headers_are_read(spark):
    heads = ["BLOQUE", "TRACKER", "MOTOR ROW", "Stake 1 North (N)", "Stake 1 East (E)", "Stake 2 North (N)", "Stake 2 East (E)", "LADO", "POS", "POS TOTAL", "STRINGS", "Notas"]
    got = H.suggest_fields(heads)
    assert got == dict(zip(("block", "tracker", "tracker_row", "start_y", "start_x", "end_y", "end_x", "side", "pos", "pos_total", "string_numbers"), heads, strict=False)) | {"pos": "POS", "pos_total": "POS TOTAL"}
    assert H.suggest_string_fields(["Código string", "Mesa", "Caja DC", "Fila"]) == {"label": "Código string", "tracker": "Mesa", "tracker_row": "Fila", "dc_box": "Caja DC"}
    same = spark.createDataFrame([(h,) for h in [*heads, "Y_Sur", "x1", "lat lon 2", "Easting B"]], "h string").select("h", H.coordinate_role(F.col("h")).alias("r")).collect()
    assert all(r.r == H._role(H._words(r.h)) for r in same) and {r.h: r.r for r in same}["Y_Sur"] == "end_y"


def test_sides_need_a_road(spark):
    near = [farm_row(f"s{i}", lat=-27.41 + i * 1e-6, rise=0.00058, lon=152.7 + i * 6e-5, at=i) for i in range(6)]
    road = [farm_row(f"n{i}", lat=-27.41 + 0.00066 + i * 1e-6, rise=0.00058, lon=152.7 + i * 6e-5, at=10 + i) for i in range(6)]
    step = [farm_row(f"e{i}", lat=-27.41 + 0.00042, rise=0.00058, lon=152.7 + i * 6e-5, at=20 + i) for i in range(4)]
    rows = lambda *groups: spark.createDataFrame([r for g in groups for r in g], ROWS).withColumn("block", F.lit("b"))
    status = lambda df: D.side_report(df)[1].first().status
    assert status(rows(near[:1])) == "ambiguo" and status(rows(near)) == "un-solo-lado" and status(rows(near, step)) == "escalonado"
    sides, report = D.side_report(rows(near, road))
    assert report.first().status == "dos-lados" and {r.row_id[0]: r.derived_side for r in sides.collect()} == {"s": "south", "n": "north"}


def test_chains(spark):
    line = [farm_row(f"c{i}", lat=-27.4 + 0.0007 * i, rise=0.00058, at=i) for i in range(3)]
    beside = [farm_row(f"p{i}", lon=152.8 + 0.0002 * i, rise=0.00058, at=i) for i in range(3)]
    alone = [farm_row("a", lon=152.9)]
    df = spark.createDataFrame([(*r, box) for box, g in (("C", line), ("P", beside), ("A", alone), (None, alone)) for r in g], f"{ROWS}, dc_box string")
    places, report = D.chain_report(df)
    assert {r.row_id: (r.pos, r.pos_total) for r in places.collect()} == {"c0": (1, 3), "c1": (2, 3), "c2": (3, 3), "p0": (1, 1), "p1": (1, 1), "p2": (1, 1), "a": (1, 1)}
    assert {r.dc_box: r["shape"] for r in report.collect()} == {"C": "cadena", "P": "paralelas", "A": "cadena"}


def test_strings_go_to_their_rows(spark):
    sheet = spark.createDataFrame([(0, "S-1.2", "01-034-R2", "D1"), (1, "S-1.1", "01-034-R2", ""), (2, "S-9", "77", None), (3, " ", "1", None)], "ord long, label string, tracker string, dc_box string")
    rows = S.row_keys(spark.createDataFrame([(0, "a", "1", "34", "R2"), (1, "b", "1", "35", "R1")], "row_ord long, row_id string, block string, tracker string, tracker_row string"))
    entries = S.read_entries(sheet)
    matches = S.match_entries(entries.withColumn("tracker", F.col("tracker_no")), rows)
    found = S.strings_of_rows(entries, matches)
    assert [(r.row_id, r.labels, r.dc_box) for r in found.collect()] == [("a", ["S-1.2", "S-1.1"], "D1")]
    out = {r.row_id: r for r in S.apply_strings(rows, found, spark.createDataFrame([("a", 2, 3)], "row_id string, pos int, pos_total int"), 1).collect()}
    assert out["a"].string_numbers == [1.0, 2.0] and out["a"].string_labels == ["S-1.1", "S-1.2"] and out["a"].pos == 2 and out["b"].string_numbers is None
    report = S.match_report(entries, rows, matches).first()
    assert (report.tier, report.matched, report.total, report.coverage, report.low, report.unmatched) == (1, 2, 3, 50, True, ["77 → S-9"])
    none = S.match_report(entries, rows, matches.limit(0)).first()
    assert (none.tier, none.matched) == (1, 0)


def test_buckets_do_not_change_ranks(spark, monkeypatch):
    monkeypatch.setattr(T, "LINES", 3)
    cells = ["a", "", None, "", "b", "", "", "", "c", " "]
    df = spark.createDataFrame([(i, "k", c) for i, c in enumerate(cells)], "ord long, key string, cell string")
    assert [r.cell for r in T.forward_fill(df, "cell", "key", "ord").orderBy("ord").collect()] == ["a"] * 4 + ["b"] * 4 + ["c"] * 2
    values = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)] + [("one", 7.5)], "key string, v double")
    got = {r.key: (r.n, r.p10, r.median, r.p90) for r in T.order_statistics(values, "key", "v", width=0.5).collect()}
    assert got == {"k": (4, 1.0, 3.0, 4.0), "one": (1, 7.5, 7.5, 7.5)}


def test_merges(spark):
    old = spark.createDataFrame([farm_row("a"), farm_row("a", lat=-27.5, at=1), farm_row("b", at=2)], ROWS)
    new = spark.createDataFrame([farm_row("a", lat=-27.5001), farm_row("b", lat=-27.401), farm_row("c")], ROWS)
    assert tuple(M.merge_counts(old, new).first()) == (1, 2)
    assert [r.row_id for r in M.collisions(old, new).collect()] == ["b"]
    lengths = spark.createDataFrame([(x,) for x in (65.145, 65.145, 66.0)], "length double")
    assert M.offset_advice(lengths, Layout()).first().offset_mm == pytest.approx(-1464, abs=0.01)


def _photo(gps, taken="2024:05:01 10:20:30"):
    """A JPEG with an EXIF block: directories of tags, values behind them."""
    def directory(at, entries):
        head, tail, free = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in entries:
            if len(data) <= 4:
                head += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, n, free + len(tail))
                tail += data
        return head + struct.pack("<I", 0) + tail

    ratio = lambda *x: b"".join(struct.pack("<II", int(v * 1000), 1000) for v in x)
    exif = directory(300, [(0x9003, 2, 20, taken.encode() + b"\0")])
    place = directory(500, [(1, 2, 2, gps[0].encode() + b"\0"), (2, 5, 3, ratio(*gps[1])), (3, 2, 2, gps[2].encode() + b"\0"), (4, 5, 3, ratio(*gps[3])), (5, 1, 1, b"\1"), (6, 5, 1, ratio(12.5)), (31, 5, 1, ratio(2.5))]) if gps else b""
    main = directory(8, [(0x8769, 4, 1, struct.pack("<I", 300)), *([(0x8825, 4, 1, struct.pack("<I", 500))] if gps else [])])
    tiff = (b"II*\0" + struct.pack("<I", 8) + main).ljust(300, b"\0")
    tiff = (tiff + exif).ljust(500, b"\0") + place
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\2"


def test_photos(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(_photo(("S", (33, 52, 7.68), "E", (151, 12, 33.48))))
    (tmp_path / "b.jpg").write_bytes(_photo(None))
    (tmp_path / "c.jpg").write_bytes(b"not a photo")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xda")
    rows = {r.file_name: r for r in read_photos(spark, str(tmp_path)).collect()}
    a = rows["a.jpg"]
    assert (a.lat, a.lon, a.accuracy, a.altitude, str(a.taken_at)) == (pytest.approx(-33.8688), pytest.approx(151.2093), 2.5, -12.5, "2024-05-01 10:20:30") and a.error is None
    assert rows["b.jpg"].error == rows["d.jpg"].error == "no-gps" and rows["c.jpg"].error == "ValueError"


def test_documents_fixtures_and_text_sheets(spark, tmp_path):
    path, schema = str(tmp_path / "farms"), "farm_id string, version long"
    docs.save_documents(spark.createDataFrame([("a", 1), ("b", 1), ("b", 3), ("c", 9)], schema), path, "farm_id", order="version")
    docs.delete_documents(spark, path, schema, spark.createDataFrame([("a",), ("none",)], "farm_id string"), "farm_id")
    assert [tuple(r) for r in docs.load_documents(spark, path, schema, "version", descending=True).collect()] == [("c", 9), ("b", 3)]
    assert [tuple(r) for r in docs.load_documents(spark, path, schema, where="version > 5").collect()] == [("c", 9)]
    assert [tuple(r) for r in docs.load_documents(spark, path, schema, key="b").collect()] == [("b", 3)]
    assert '"farm_id" : "c"' in docs.exported(docs.load_documents(spark, path, schema, key="c")).first().json
    (tmp_path / "fix").mkdir()
    for name, text in (("b.json", '{"farm": "x"}'), ("_t.json", '{"farm": "t"}'), ("a.json", '{\n"farm": "y"}')):
        (tmp_path / "fix" / name).write_text(text)
    assert [r.farm for r in docs.load_fixtures(spark, str(tmp_path / "fix"), "farm string").collect()] == ["y", "x"]
    (tmp_path / "s.tsv").write_text("A\tB\n1\t\n\n2\tx\ty\n")
    rows = docs.read_text_sheets(spark, str(tmp_path / "s.tsv"), "\t").orderBy("ord").collect()
    assert [r.cells for r in rows] == [{"A": "1", "B": None}, {"A": "2", "B": "x"}]


def test_profiles_and_reviews(spark):
    farm = P.farm_of(P.PRESETS["pvh-28x2"], 0.0, 0.0)
    assert farm.layout.extent + 2 * farm.layout.offset == pytest.approx(65.145) and farm.pitch is None
    bare = {k: v for k, v in P.PRESETS["generico"].items() if k != "matching"}
    assert P.farm_of(bare, 0.0, 0.0).max_distance == 30.0 and P.farm_of(bare, 0.0, 0.0).fixed_end == "north"
    schema = "fix_id long, status string, klass int, delta_t double, note string"
    found = spark.createDataFrame([(1, "confirmado", 2, 5.0, "n"), (2, "pendiente", None, None, None)], schema)
    edits = spark.createDataFrame([(1, "confirmado", 2, 0.0, "")], schema)
    assert [tuple(r) for r in R.reviewed(found, edits).orderBy("fix_id").collect()] == [(1, "pendiente", None, None, None), (2, "pendiente", None, None, None)]


def test_a_report_has_one_header(spark, tmp_path):
    address = "struct<block:string,tracker:string,tracker_row:string,string_number:double,module:int,counted_from:string,confidence:double>"
    schema = f"fix_id long, file_name string, taken_at string, lat double, lon double, accuracy double, address {address}, module_fixed int, anomaly string, klass int, delta_t double, status string, note string, codes string"
    rows = [(1, "a,b.jpg", None, -27.4, 152.7, 3.0, ("1", "2", None, 5.0, 7, "near-dc", 0.456), None, None, 2, 1.5, "pendiente", 'say "x"', "low-confidence,ambiguous"), (2, "b", None, 0.0, 0.0, None, None, None, None, None, None, "descartado", None, "")]
    R.write_report(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "out"))
    lines = (tmp_path / "out").read_text().split("\n")
    assert lines == [",".join(R.CSV_COLUMNS), '"a,b.jpg",,-27.4000000,152.7000000,3,1,2,,5,7,caja DC,,46%,,2,1.5,pendiente,"say ""x""",low-confidence ambiguous']
