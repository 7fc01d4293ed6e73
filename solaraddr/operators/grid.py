"""The range join of fixes and rows on a grid that divides where fixes crowd: a quadtree over counts, as equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiled import Farm
from .locate import _BOUNDS, measured, on_plane

#: How often a cell may be divided into four.
LEVELS = 6
#: A cell that holds more fixes than this and more than one in SHARES of all is divided; so fewer than SHARES cells of a level are.
LEAST, SHARES = 2000, 1000


def _sides(compiled: DataFrame, farm: Farm) -> DataFrame | float:
    """Metres of an undivided cell: the power of two that holds the padded bounds of a middling row (and so follows the greatest distance)."""
    side = F.pow(F.lit(2.0), F.greatest(F.lit(4), F.ceil(F.log2(F.avg(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))))))
    if farm.by:
        return compiled.groupBy(*farm.by).agg(side.alias("_side"))
    return compiled.agg(side.alias("_side")).first()[0] or 64.0


def _sided(df: DataFrame, sides: DataFrame | float, farm: Farm) -> DataFrame:
    if isinstance(sides, float):
        return df.withColumn("_side", F.lit(sides))
    return df.join(F.broadcast(sides) if farm.few else sides, list(farm.by))


def _at(fine: str, level: int | Column) -> Column:
    """The cell of a level that holds a finest one."""
    return F.shiftright(F.col(fine), LEVELS - level) if isinstance(level, int) else F.call_function("shiftright", F.col(fine), (F.lit(LEVELS) - level).cast("int"))


class Cells:
    """Cells of fixes and of rows, such that each pair that may be in range shares exactly one.

    A fix lies in one leaf of the quadtree; a row is listed in each leaf that its bounds touch. A leaf of the last level that is
    still crowded (many fixes at one place) is dealt into parts by the fixes' ids, and rows are listed in all of its parts.
    The divided cells are fewer than LEVELS * SHARES by their counts, so they are gathered and broadcast.
    """

    def __init__(self, fixes: DataFrame, compiled: DataFrame, farm: Farm, least: int = LEAST):
        self.by, spark = list(farm.by), fixes.sparkSession
        sides = _sides(compiled, farm)
        fine = lambda c: F.floor(F.col(c) / F.col("_side") * 2**LEVELS)
        points = _sided(on_plane(fixes, farm).select(*fixes.columns, "x", "y"), sides, farm)
        points = points.withColumns({"_fx": fine("x"), "_fy": fine("y")}).drop("_side")
        counts = points.groupBy(*self.by, "_fx", "_fy").agg(F.count("*").alias("n"))
        self.most = max(least, -(-fixes.count() // SHARES))
        levels = counts.select(*self.by, "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), "_fx", "_fy")
        level = F.col("level")
        levels = levels.groupBy(*self.by, "level", _at("_fx", level).alias("qx"), _at("_fy", level).alias("qy")).agg(F.sum("n").alias("n"))
        crowded = levels.where(F.col("n") > self.most)
        self.crowded = spark.createDataFrame(crowded.collect(), crowded.schema)
        self.depth = max((r.level for r in self.crowded.select("level").distinct().collect()), default=-1)
        slim = _sided(compiled, sides, farm)
        self.fixes, self.rows = self._of_fixes(points), self._of_rows(slim)

    def _joined(self, df: DataFrame, level: int, x: Column, y: Column, name: str, *more: Column) -> DataFrame:
        """`df` with the count of its cell of this level as `name`, 0 unless the cell is crowded; more conditions may be asked for."""
        keys = [F.col(c).alias(f"_of_{c}") for c in self.by]
        hot = self.crowded.where(F.col("level") == level).select(*keys, F.col("qx").alias("_qx"), F.col("qy").alias("_qy"), F.col("n").alias(name))
        on = (x == F.col("_qx")) & (y == F.col("_qy"))
        for c in (*[F.col(c) == F.col(f"_of_{c}") for c in self.by], *more):
            on = on & c
        return df.join(F.broadcast(hot), on, "left").select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))

    def _of_fixes(self, points: DataFrame) -> DataFrame:
        # a crowded cell lies in crowded ones, so the number of crowded cells around a fix is the level of its leaf
        out = points.withColumn("_level", F.lit(0))
        for k in range(min(self.depth + 1, LEVELS)):
            out = self._joined(out, k, _at("_fx", k), _at("_fy", k), "_n").withColumn("_level", F.col("_level") + (F.col("_n") > 0).cast("int")).drop("_n")
        if self.depth == LEVELS:
            out = self._joined(out, LEVELS, F.col("_fx"), F.col("_fy"), "_n")
        else:
            out = out.withColumn("_n", F.lit(0))
        parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / self.most))
        level = F.col("_level")
        return out.withColumns({"qx": _at("_fx", level), "qy": _at("_fy", level), "part": F.pmod(F.xxhash64("fix_id"), parts)}).withColumnRenamed("_level", "level").drop("_fx", "_fy", "_n")

    def _of_rows(self, rows: DataFrame) -> DataFrame:
        side = F.col("_side")
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))
        out = rows.withColumn("qx", span("min_x", "max_x")).withColumn("qy", span("min_y", "max_y")).withColumn("level", F.lit(0))
        for k in range(min(self.depth + 1, LEVELS)):
            own = side / 2 ** (k + 1)
            out = self._joined(out, k, F.col("qx"), F.col("qy"), "_n", F.col("level") == k)
            low, high = lambda c: F.floor(F.col(f"min_{c}") / own), lambda c: F.floor(F.col(f"max_{c}") / own)
            four = [F.struct((F.col("qx") * 2 + i).alias("qx"), (F.col("qy") * 2 + j).alias("qy"), F.lit(k + 1).alias("level")) for i in (0, 1) for j in (0, 1)]
            inside = F.filter(F.array(*four), lambda q: q["qx"].between(low("x"), high("x")) & q["qy"].between(low("y"), high("y")))
            cells = F.when(F.col("_n") > 0, inside).otherwise(F.array(F.struct("qx", "qy", "level")))
            out = out.withColumn("_cell", F.explode(cells)).drop("qx", "qy", "level", "_n").select("*", "_cell.qx", "_cell.qy", "_cell.level").drop("_cell")
        if self.depth == LEVELS:
            out = self._joined(out, LEVELS, F.col("qx"), F.col("qy"), "_n", F.col("level") == LEVELS)
        else:
            out = out.withColumn("_n", F.lit(0))
        parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / self.most))
        return out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n", "_side")


def adaptive_rows_in_range(fixes: DataFrame, compiled: DataFrame, farm: Farm, carried: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """The pairs of `rows_in_range`, by a grid whose cells follow row lengths, greatest distance and crowds of fixes.

    It reads the fixes once more, to count them, and the compiled rows; so both should be tables. No key of the join holds more fixes than
    `least` or one in SHARES of all, however they are spread.
    """
    slim = compiled.select(*farm.by, "row_id", "row_ord", *dict.fromkeys((*_BOUNDS, *carried)))
    cells = Cells(fixes, slim, farm, least)
    key = [*farm.by, "level", "qx", "qy", "part"]
    return measured(cells.fixes.join(cells.rows, key)).drop("level", "qx", "qy", "part")
