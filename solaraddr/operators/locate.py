"""From compiled rows and fixes to ranked module candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import norm, project_on_unit, to_geo, to_local
from ..functions.layout import Layout
from .compiled import Farm, compile_rows, fix_key

#: Positions to either side of the nearest one, at most.
MOST_NEIGHBOURS = 12
#: What the join of fixes and rows needs of a row, besides its id and order.
_BOUNDS = ("ax", "ay", "ux", "uy", "length", "min_x", "max_x", "min_y", "max_y")
#: What of a row goes on to its candidates.
_CARRIED = ("ax", "ay", "ux", "uy", "length", "pitch", "origin_offset", "residual_mm", "origin_end", "inverted", "numbers", "labels", "strategy_warnings")

#: The order of a fix's candidates.
_BY_RANK = ("module_distance", "row_rank", "position")


def rows_in_range(fixes: DataFrame, compiled: DataFrame, farm: Farm, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of fixes and rows whose padded bounds hold the fix, with the distance along and to the row.

    An equi-join on grid cells: a row is listed in each cell that its bounds touch, a fix in its own one, so each pair meets once
    and no nested loop is needed, however many rows there are. A crowded cell is a skewed key, which the planner splits. Only
    what the join needs and `carried` is copied to the cells. Both sides are shuffled: the planner takes the cells for no larger
    than the table that they come from and would gather them on the driver to broadcast them.
    """
    cell = lambda c: F.floor(F.col(c) / farm.cell_size)
    points = on_plane(fixes, farm, "cell_size").withColumns({"cx": cell("x"), "cy": cell("y")}).select(*fixes.columns, "x", "y", "cx", "cy")
    slim = compiled.select(*farm.by, "row_id", "row_ord", *dict.fromkeys((*_BOUNDS, *carried)))
    cells = farm.attached(slim, "cell_size").withColumn("cx", F.explode(F.sequence(cell("min_x"), cell("max_x")))).withColumn("cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))
    pairs = points.join(cells.select(*slim.columns, "cx", "cy").hint("merge"), [*farm.by, "cx", "cy"])
    return measured(pairs).drop("cx", "cy")


def on_plane(fixes: DataFrame, farm: Farm, *fields: str) -> DataFrame:
    """Adds x and y on the farm's plane to fixes, and columns of further fields."""
    x, y = to_local(F.col("lat"), F.col("lon"), F.lit(farm.lat), F.lit(farm.lon))
    return farm.attached(fixes, "lat", "lon", *fields).withColumns({"x": x, "y": y})


def measured(pairs: DataFrame) -> DataFrame:
    """Of pairs of fixes and rows those whose padded bounds hold the fix, with the distance along the row, off its axis and to its segment."""
    pairs = pairs.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along, off = project_on_unit(dx, dy, F.col("ux"), F.col("uy"))
    pairs = pairs.withColumns({"along": along, "off_axis": off})
    clamped = F.least(F.greatest(F.col("along"), F.lit(0.0)), F.col("length"))
    return pairs.withColumn("distance", norm(dx - F.col("ux") * clamped, dy - F.col("uy") * clamped)).drop("min_x", "max_x", "min_y", "max_y")


def rows_considered(pairs: DataFrame) -> DataFrame:
    """fix_id and the number of rows whose bounds hold it, whatever their distance."""
    return pairs.groupBy(fix_key(pairs)).agg(F.count("*").alias("rows_considered"))


def nearest_rows(pairs: DataFrame, farm: Farm) -> DataFrame:
    """The nearest rows of each fix within the limit, ranked from 1; ties in the order of rows."""
    order = Window.partitionBy(fix_key(pairs)).orderBy("distance", "row_ord")
    near = farm.attached(pairs, "max_distance").where(F.col("distance") <= farm.max_distance).select(pairs.columns)
    near = near.withColumn("row_rank", F.row_number().over(order)).where(F.col("row_rank") <= farm.most_rows)
    return near if isinstance(farm.rows, int) else farm.attached(near, "rows").where(F.col("row_rank") <= F.greatest(F.lit(1), farm.rows)).select(near.columns)


def nearest_row(points: DataFrame, compiled: DataFrame, farm: Farm, tolerance: float) -> DataFrame:
    """The one nearest row of each point (fix_id, lat, lon) within `tolerance` metres; points without one are left out."""
    near = rows_in_range(points, compiled, farm).where(F.col("distance") <= tolerance)
    return near.groupBy(fix_key(near)).agg(F.min(F.struct("distance", "row_ord", "row_id")).alias("_best")).select(*fix_key(near), "_best.row_id", "_best.distance")


def _layout(farm: Farm) -> Layout:
    return farm.layout.of_rows(F.col("pitch"), F.col("origin_offset"))


def _from_origin(distance: Column) -> Column:
    """From the start of a row to its origin end, and back."""
    return F.when(F.col("origin_end") == "start", distance).otherwise(F.col("length") - distance)


def _placed(near: DataFrame, farm: Farm) -> DataFrame:
    """The position of each fix on each of its rows, and how far around it modules are candidates."""
    near = farm.attached(near)
    position, in_gap, raw = _layout(farm).position_at(F.col("from_origin"))
    sigma = F.when(F.col("accuracy") > 0, F.col("accuracy")).otherwise(F.lit(farm.accuracy))
    winner = F.max(F.when(F.col("row_rank") == 1, F.col("pitch"))).over(Window.partitionBy(fix_key(near)))
    reach = F.least(F.lit(MOST_NEIGHBOURS), F.greatest(F.lit(farm.neighbourhood), F.ceil(2 * F.col("sigma") / F.col("winner_pitch")))).cast("int")
    out = near.withColumn("from_origin", _from_origin(F.col("along"))).withColumns({"centre": position, "in_gap": in_gap, "raw": raw, "sigma": sigma, "winner_pitch": winner})
    return out.withColumns({"reach": reach, "outside": (F.col("raw") < 1) | (F.col("raw") > farm.layout.total)})


def _addressed(out: DataFrame, farm: Farm) -> DataFrame:
    """What an address says of the module at `position`."""
    layout = _layout(farm)
    out = out.withColumn("chunk", layout.chunk(F.col("position"))).withColumn("turned", F.coalesce(F.get("inverted", F.col("chunk")), F.lit(False)))
    start = _from_origin(layout.distance_at(F.col("position")))
    out = out.withColumns(
        {
            "module": layout.module(F.col("position"), F.col("turned")),
            "counted_from": F.when(F.col("turned"), "far-end").otherwise("near-dc"),
            "string_number": F.coalesce(F.get("numbers", F.col("chunk")), F.col("chunk") + F.lit(1.0)),
            "string_label": F.nullif(F.get("labels", F.col("chunk")), F.lit("")),
            "mx": F.col("ax") + F.col("ux") * start,
            "my": F.col("ay") + F.col("uy") * start,
        }
    )
    lat, lon = to_geo(F.col("mx"), F.col("my"), F.lit(farm.lat), F.lit(farm.lon))
    return out.withColumns({"module_distance": norm(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), "module_lat": lat, "module_lon": lon})


def _spread(near: DataFrame, farm: Farm) -> tuple[DataFrame, Column, Column]:
    """Fixes on their rows, and the first and last position that is a candidate there."""
    low, high = F.greatest(F.lit(1), F.col("centre") - F.col("reach")), F.least(F.lit(farm.layout.total), F.col("centre") + F.col("reach"))
    return _placed(near, farm), low, high


def best_modules(near: DataFrame, farm: Farm) -> DataFrame:
    """The first of `candidates` for each fix, without its confidence: only the modules next to the fix are looked at, not all in reach.

    They are the one at the fix and its neighbours and, for a fix in a gap, the last and first of the strings beside it. Row ids
    have to be unique.
    """
    n, layout = farm.layout.modules, _layout(farm)
    out, low, high = _spread(near, farm)
    string = layout.chunk(F.col("centre")) * n
    places = F.array(*[F.least(F.greatest(p, low), high) for p in (F.col("centre") - 1, F.col("centre"), F.col("centre") + 1, string, string + 1)])
    d = F.col("from_origin")
    nearest = F.array_min(F.transform(places, lambda p: F.struct(F.abs(layout.distance_at(p) - d).alias("off"), p.cast("int").alias("position"))))
    out = _addressed(out.withColumn("position", nearest["position"]), farm)
    first = F.row_number().over(Window.partitionBy(fix_key(out)).orderBy("module_distance", "row_rank", "position"))
    return out.withColumn("rank", first).where("rank = 1")


def candidates(near: DataFrame, farm: Farm) -> DataFrame:
    """Modules around each fix on its nearest rows, with rank by distance and Gaussian confidence.

    All rows take the reach of the nearest one's pitch. Of rows that share an id the nearest keeps a position that both have.
    """
    out, low, high = _spread(near, farm)
    # in the order that the rows were ranked by, so they are not sorted again
    before = Window.partitionBy(fix_key(out)).orderBy("distance", "row_ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("row_id", low.alias("low"), high.alias("high"))).over(before)
    out = out.withColumn("_earlier", earlier).withColumn("_taken", F.filter("_earlier", lambda o: o["row_id"].eqNullSafe(F.col("row_id"))))
    free = F.filter(F.sequence(low, high), lambda p: ~F.exists("_taken", lambda o: p.between(o["low"], o["high"])))
    out = out.withColumn("position", F.explode(F.when(F.size("_taken") == 0, F.sequence(low, high)).otherwise(free))).drop("_earlier", "_taken")
    out = _addressed(out, farm)
    # candidates are sorted once, for their ranks; whatever else is told of a fix keeps that order
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(fix_key(out)).orderBy(*_BY_RANK)))
    w = F.exp(-0.5 * F.pow(F.col("module_distance") / F.col("sigma"), 2))
    total = F.sum("weight").over(Window.partitionBy(fix_key(out)))
    return out.withColumn("weight", w).withColumn("confidence", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def warnings(found: DataFrame) -> DataFrame:
    """One row for each fix: warning codes in their fixed order, from the nearest row (rules, gap, extent) and the best candidates."""
    own = Window.partitionBy(fix_key(found))
    best = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(own)
    rows = found.withColumns({"top": best("confidence"), "top_row": best("row_id"), "top_string": best("string_number")})
    rival = (F.col("rank") > 1) & (F.col("confidence") > 0.6 * F.col("top")) & ((F.col("row_id") != F.col("top_row")) | (F.col("string_number") != F.col("top_string")))
    nearest = F.col("row_rank") == 1
    facts = rows.groupBy(fix_key(found)).agg(
        F.bool_or(nearest & F.col("in_gap")).alias("gap"),
        F.bool_or(nearest & F.col("outside")).alias("outside"),
        F.max(F.when(nearest, F.array_join("strategy_warnings", ","))).alias("rules"),
        F.max("top").alias("top"),
        F.bool_or(rival).alias("rival"),
    )
    codes = [F.nullif("rules", F.lit("")), F.when(F.col("gap"), "in-string-gap"), F.when(F.col("outside"), "outside-row-extent"), F.when(F.col("top") < 0.35, "low-confidence"), F.when(F.col("rival"), "ambiguous")]
    return facts.select(*fix_key(found), F.concat_ws(",", *codes).alias("codes"))


def warning_records(found: DataFrame, farm: Farm) -> DataFrame:
    """One row for each fix: `warnings`, an array of what `warnings` names, in the same order, with what each is about.

    code, row_id (the nearest row's; the rival's for ambiguous; null for low-confidence), raw and total (the unclamped position and
    the modules of the row: outside-row-extent), low, high and sigma (positions in question on the best row: low-confidence), string_number,
    distance and best_distance (the first rival by rank and the best module: ambiguous). What does not belong to a code is null.
    The candidates of a fix are few: they are gathered once, by rank, and all is read off that array.
    """
    one = F.struct("rank", "row_id", "string_number", "confidence", "module_distance", "position")
    nearest = F.struct("row_id", "in_gap", "outside", "raw", "strategy_warnings", F.lit(farm.layout.total).alias("total"))
    per = found.groupBy(fix_key(found)).agg(F.array_sort(F.collect_list(one)).alias("all"), F.max(F.when(F.col("row_rank") == 1, nearest)).alias("near"), F.max("sigma").alias("sigma"))
    per = per.withColumn("best", F.get("all", F.lit(0)))
    row, string = F.col("best.row_id"), F.col("best.string_number")
    rival = F.get(F.filter("all", lambda c: (c["rank"] > 1) & (c["confidence"] > 0.6 * F.col("best.confidence")) & ((c["row_id"] != row) | (c["string_number"] != string))), F.lit(0))
    own = F.transform(F.filter("all", lambda c: c["row_id"] == row), lambda c: c["position"])
    per = per.withColumns({"rival": rival, "low": F.array_min(own), "high": F.array_max(own)})
    kinds = {"row_id": "string", "raw": "double", "total": "int", "low": "int", "high": "int", "sigma": "double", "string_number": "double", "distance": "double", "best_distance": "double"}

    def record(code: Column, **facts: Column) -> Column:
        return F.struct(code.alias("code"), *[facts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

    at = F.col("near.row_id")
    later = F.array(
        F.when(F.col("near.in_gap"), record(F.lit("in-string-gap"), row_id=at)),
        F.when(F.col("near.outside"), record(F.lit("outside-row-extent"), row_id=at, raw=F.col("near.raw"), total=F.col("near.total"))),
        F.when(F.col("best.confidence") < 0.35, record(F.lit("low-confidence"), low=F.col("low"), high=F.col("high"), sigma=F.col("sigma"))),
        F.when(
            F.col("rival").isNotNull(),
            record(F.lit("ambiguous"), row_id=F.col("rival.row_id"), string_number=F.col("rival.string_number"), distance=F.col("rival.module_distance"), best_distance=F.col("best.module_distance")),
        ),
    )
    rules = F.transform("near.strategy_warnings", lambda c: record(c, row_id=at))
    return per.select(*fix_key(found), F.concat(rules, F.filter(later, lambda x: x.isNotNull())).alias("warnings"))


def near_rows(fixes: DataFrame, rows: DataFrame, farm: Farm) -> DataFrame:
    """The nearest rows of each fix with all that candidates need."""
    return near_compiled(fixes, compile_rows(rows, farm), farm)


def near_compiled(fixes: DataFrame, compiled: DataFrame, farm: Farm) -> DataFrame:
    """The same for rows that are compiled already."""
    return nearest_rows(rows_in_range(fixes, compiled, farm, _CARRIED), farm)


def locate(fixes: DataFrame, rows: DataFrame, farm: Farm) -> DataFrame:
    """All candidates of all fixes: fix_id, lat, lon, accuracy against the rows that `compile_rows` takes, with row_ord.

    One shuffle by cell and one by fix. Fixes without a row in range have no candidates; see `without_rows`.
    """
    return candidates(near_rows(fixes, rows, farm), farm)


def winners(near: DataFrame, farm: Farm) -> DataFrame:
    """What is known of the nearest row of each fix: its place along the row, lengths, rules and residual."""
    chunk = farm.layout.chunk(F.col("centre"))
    return _placed(near, farm).where("row_rank = 1").select(
        *fix_key(near), "row_id", (F.col("along") / F.col("length")).alias("t"), F.col("from_origin").alias("along_from_origin"), F.col("length").alias("segment_length"), "pitch", "origin_offset",
        "origin_end", F.lit(farm.origin).alias("origin_strategy"), F.lit(farm.inversion).alias("inversion_strategy"), F.coalesce(F.get("inverted", chunk), F.lit(False)).alias("inverted"), "residual_mm",
    )


def without_rows(fixes: DataFrame, rows: DataFrame, farm: Farm) -> DataFrame:
    near = farm.attached(rows_in_range(fixes, compile_rows(rows, farm), farm), "max_distance").where(F.col("distance") <= farm.max_distance)
    return fixes.join(near.select(fix_key(fixes)).distinct(), fix_key(fixes), "left_anti").select(*fix_key(fixes), F.lit("no-row-within-range").alias("code"))


def best_row_range(found: DataFrame) -> DataFrame:
    """The least and greatest candidate position on the row of each fix's best module."""
    best = F.max(F.when(F.col("rank") == 1, F.col("row_id"))).over(Window.partitionBy(fix_key(found)))
    return found.withColumn("_top", best).where("row_id = _top").groupBy(*fix_key(found), "row_id").agg(F.min("position").alias("first"), F.max("position").alias("last"))


def credible_range(found: DataFrame, share: float = 0.85) -> DataFrame:
    """Candidates of the best row, likeliest first, until their confidences reach `share` of all: positions, modules and strings."""
    own = Window.partitionBy(fix_key(found))
    top = found.withColumn("top_row", F.max(F.when(F.col("rank") == 1, F.col("row_id"))).over(own)).where("row_id = top_row")
    before = F.coalesce(F.sum("confidence").over(own.orderBy(*_BY_RANK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = top.withColumn("before", before).where(F.col("before") < share)
    return kept.groupBy(fix_key(found)).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.min("module").alias("low_module"), F.max("module").alias("high_module"),
        (F.count_distinct("string_number") == 1).alias("one_string"), F.min_by("string_number", "rank").alias("string_number"),
    )


def address_text(block: Column, tracker: Column, row: Column, string: Column, module: Column, counted_from: Column) -> Column:
    """A module's address in words."""
    number = F.when(string == F.floor(string), string.cast("long").cast("string")).otherwise(string.cast("string"))
    end = F.when(counted_from == "near-dc", "from the DC box").otherwise("from the far end")
    return F.concat(F.lit("Block "), block, F.lit(", tracker "), tracker, F.coalesce(F.concat(F.lit(" "), F.nullif(row, F.lit(""))), F.lit("")), F.lit(", string "), number, F.lit(", module "), module.cast("string"), F.lit(" ("), end, F.lit(")"))
