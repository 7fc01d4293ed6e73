"""Streams: reviews with state, photos as files; and the small repairs of this round."""

import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from solaraddr.functions.geo import utm_to_wgs84
from solaraddr.functions.layout import Layout
from solaraddr.operators import merging as M
from solaraddr.operators import report as R
from solaraddr.operators import sides as D
from solaraddr.operators import tables as T
from solaraddr.sources.store import Store
from solaraddr.streaming.locate import fixes_of_photos, ingest_photos
from solaraddr.streaming.reviews import EDIT, FIELDS, RECORD, review_stream


def test_reviews_fold_into_a_record(spark, tmp_path):
    """Four drops of edits, the third repeating the first, the fourth with late ones: the last edit of each field wins."""
    rng, begin = random.Random(11), datetime(2026, 1, 1)

    def edit(i):
        values = [rng.choice([None, "confirmado", "pendiente"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 4.5]), rng.choice([None, 7]), rng.choice([None, "Sombra"]), rng.choice([None, "ñ"])]
        return (f"f{i % 5}", begin + timedelta(seconds=rng.randrange(40)), f"e{i:03d}", *values, rng.choice([None, ["note"], ["klass", "status"]]))

    first, second, late = [edit(i) for i in range(30)], [edit(i) for i in range(30, 60)], [("f0", begin - timedelta(days=1), "x", "descartado", 3, 1.0, 1, "PID", "old", None)]
    store = Store(spark, str(tmp_path / "store"), RECORD, "finding_id")
    for i, drop in enumerate((first, second, first, late)):
        spark.createDataFrame(drop, EDIT).coalesce(1).write.mode("append").json(str(tmp_path / "edits"))
        stream = spark.readStream.schema(EDIT).json(str(tmp_path / "edits"))
        query = review_stream(stream, store, str(tmp_path / "state"), once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        if i == 1:
            version = store.versions()[-1]
    want = {}
    for f, at, e, *values, cleared in first + second + late:
        for name, v in zip(FIELDS, values):
            if (v is not None or name in (cleared or ())) and ((at, e) > want.setdefault(f, {}).get(name, (datetime.min, ""))[:2]):
                want[f][name] = (at, e, None if name in (cleared or ()) else v)
    got = {r.finding_id: r for r in store.load().collect()}
    assert {f: {k: v[2] for k, v in x.items()} for f, x in want.items()} == {f: {k: r[k] for k in want[f]} for f, r in got.items()}
    assert all(r.edited_at == max(v[0] for v in want[f].values()) for f, r in got.items())
    # repeats and late edits made no version
    assert store.versions()[-1] == version


def jpeg(lat):
    """A JPEG with a GPS block: whole degrees south and 150 east."""
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    gps_at, data = 26, 26 + 2 + 4 * 12 + 4
    rational = lambda *x: b"".join(struct.pack("<II", v, 1) for v in x)
    main = struct.pack("<H", 1) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + bytes(4)
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", data)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", data + 24)) + bytes(4)
    tiff = b"II*\0" + struct.pack("<I", 8) + main + gps + rational(lat, 0, 0) + rational(150, 0, 0)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"


def test_photos_arrive_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for drop in ({"a.jpg": jpeg(27), "bad.jpg": b"no photo"}, {"b.jpg": jpeg(28)}, {}):
        folder.mkdir(exist_ok=True)
        for name, raw in drop.items():
            (folder / name).write_bytes(raw)
        query = ingest_photos(spark, str(folder), out, state, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
    photos = spark.read.parquet(out)
    assert sorted((r.file_name, r.lat, r.error) for r in photos.collect()) == [("a.jpg", -27.0, None), ("b.jpg", -28.0, None), ("bad.jpg", None, "ValueError")]
    assert fixes_of_photos(photos).count() == 2


def test_zones_that_are_none(spark):
    zone = lambda z, strict: spark.range(1).select(*utm_to_wgs84(F.lit(5e5), F.lit(6e6), F.lit(z), F.lit(True), strict))
    assert zone(0, False).first()[0] is None and zone(56.5, False).first()[0] is None and zone(56, True).first()[1] == pytest.approx(153)
    for bad in (0, 61, 56.5):
        with pytest.raises(Exception, match="no UTM zone"):
            zone(bad, True).collect()


def test_order_statistics_of_equal_and_near_values(spark):
    """Thousands of lengths inside of a millimetre, many of them equal, as rows of one farm have."""
    rng = random.Random(2)
    values = [65.145 + rng.choice([0.0, 0.0001, rng.random() * 1e-4]) for _ in range(4000)] + [80.0]
    df = spark.createDataFrame([(v,) for v in values], "length double")
    out = M.offset_advice(df, Layout(), stated_mm=-1464.0).first()
    s = sorted(values)
    assert (out.n, out.median, out.p10, out.p90) == (4001, s[2000], s[400], s[3600]) and not out.suggest and not out.uneven


def test_reports_carry_their_place(spark):
    names = [(n,) for n in ("zeta", "Ñandú", "nube", "Álamo", "alba", "alba", "Eden", "élan", None)]
    df = spark.createDataFrame(names, "name string")
    assert [r.name for r in T.by_locale(df, "name").orderBy("place").collect()] == [None, "Álamo", "alba", "alba", "Eden", "élan", "Ñandú", "nube", "zeta"]
    blocks = spark.createDataFrame([(b,) for b in ("10", "1", "1!", "2", "A", "a")], "block string")
    # a comma after each, as in text of pairs: "1!," comes before "1,"
    assert [r.block for r in T.by_text(blocks, "block").orderBy("place").collect()] == ["1!", "1", "10", "2", "A", "a"]
    assert [r.id for r in R.shown(spark.range(50), "chain reports", F.desc("id")).collect()] == list(range(49, 37, -1)) and len(R.SHOWN) == 6


def test_a_block_of_many_rows_has_its_sides(spark):
    """Two groups of rows along one axis over several stretches of it, with a road in the middle."""
    k = F.col("id")
    lat = F.lit(-27.4) + F.floor(k / 40) * 0.00066 + F.when(k >= 400, 0.0006).otherwise(0.0)
    rows = spark.range(800).select(k.alias("row_ord"), k.cast("string").alias("row_id"), F.lit("b").alias("block"), lat.alias("lat_a"), (F.lit(152.7) + k % 40 * 0.00006).alias("lon_a"), (lat + 0.00058).alias("lat_b"), (F.lit(152.7) + k % 40 * 0.00006).alias("lon_b"))
    sides, report = D.side_report(rows)
    r = report.first()
    assert (r.status, r.rows, r.lower, r.upper) == ("dos-lados", 800, 400, 400)
    assert {(x.side, x.n, x.low) for x in sides.groupBy(F.col("derived_side").alias("side")).agg(F.count("*").alias("n"), F.min("row_ord").alias("low")).collect()} == {("south", 400, 0), ("north", 400, 400)}
