"""Every slot of a row is found again from its centre, and numbers keep their rules."""

import pytest
from pyspark.sql import functions as F

from solaraddr.functions.layout import Layout
from solaraddr.functions.text import to_number, tracker_ref


def test_each_position_survives_the_round_trip(spark):
    layout = Layout()
    df = spark.range(1, 57).select(F.col("id").alias("p"))
    position, in_gap, _ = layout.position_at(layout.distance_at(F.col("p")))
    rows = df.select("p", position.alias("q"), in_gap.alias("g")).collect()
    assert all(r.p == r.q and not r.g for r in rows)


def test_the_gap_overflows_into_the_next_string(spark):
    layout = Layout()
    d = layout.offset + layout.span + 3.6
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(layout.position_at(F.lit(d)), "pgr", strict=True)]).first()
    assert (row.p, row.g) == (32, True)


@pytest.mark.parametrize(("text", "number"), [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("6 965 000", 6965000.0), ("-27,4", -27.4), ("-27,400", -27400.0), ("", None), ("north", None), ("1d", None)])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == number


@pytest.mark.parametrize(("text", "parts"), [("01-034-R2", ("1", "34", "R2")), ("34", (None, "34", None)), ("TRACKER 5", (None, "tracke", "R5")), ("TR-12", (None, "t", "R12"))])
def test_tracker_references(spark, text, parts):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(*tracker_ref(F.col("t"))).first()) == parts
