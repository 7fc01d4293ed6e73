"""Places of rows within ordered groups, looked-up keys, and runs of sorted rows inside tasks; a hot group is never one task's work."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import partitions, written

#: A key with more than one in so many of all rows is frequent: there are fewer such keys than this, whatever the input.
FREQUENT = 1000


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def placed(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `place` (from 0, by `order`, nulls first) and `n` (rows) within each group; without groups, all rows are one.

    Rows are dealt into ranges of (groups, order), sorted there and written with running numbers, so a group spans as many parts
    as it needs; where each group's share of a part begins is a prefix sum over a row a part and group.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_row", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_row", 33))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy(*groups, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    runs = runs.withColumns({"_start": F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first"), "n": F.sum("_count").over(whole)})
    runs = runs.select(*[F.col(c).alias(f"_g_{c}") for c in groups], F.col("_part").alias("_p"), "_start", "n")
    on = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_g_{c}")), groups, F.col("_part") == F.col("_p"))
    return dealt.join(runs, on).withColumn("place", F.col("_row") + F.col("_start")).select(*df.columns, "place", "n")


def looked_up(rows: DataFrame, names: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Joins `names` (keys that are never null, `_rows` with the number of rows of each, and more) to `rows`, of which there are `total`.

    Keys of more than total / FREQUENT rows, fewer than FREQUENT of them by their counts, are broadcast; others meet by a shuffle,
    in which no key is large. Both tables are read twice, so they should be written.
    """
    often = F.col("_rows") > total / FREQUENT
    hot, rest = F.broadcast(names.where(often).drop("_rows")), names.where(~often).drop("_rows")
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of consecutive rows that agree in their first `keys` columns, across batches: (those values, rows). A run is held whole."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield key, held


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
