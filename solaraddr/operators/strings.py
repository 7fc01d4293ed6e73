"""String lists against tracker rows: entries, keys from strict to loose, pairing by order inside a tracker, reports, and what rows gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numeric_fields, tracker_ref

# How geometry names the rows of a tracker, in order.
GEOMETRY_ORDER = ("motorizada", "esclava")
BY_ORDER = 5
#: Entries that a report names as unmatched, shows as read, and pairs it shows; labels and values that describe a field.
UNMATCHED, SHOWN, PAIRS, LABELS, VALUES = 6, 3, 4, 500, 6


def read_entries(sheet: DataFrame, naming: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Entries of a list (ord, label, tracker, and if there tracker_row, dc_box): those with a label and a tracker, trimmed, with their reference.

    Adds block, tracker_no and label_row: the row of the list's own column, else the one in the tracker's text.
    """
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in sheet.columns else F.lit(None).cast("string")
    out = sheet.select("ord", *[cell(c).alias(c) for c in ("label", "tracker", "tracker_row", "dc_box")]).where("label IS NOT NULL AND tracker IS NOT NULL")
    block, tracker, row = tracker_ref(F.col("tracker"))
    return out.withColumns({"block": block, "tracker_no": tracker, "label_row": canon_row(F.coalesce("tracker_row", row), **(naming or {}))})


def row_keys(rows: DataFrame, naming: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows (row_ord, row_id, block, tracker, tracker_row) with their reference as matching compares it."""
    block, tracker, _ = tracker_ref(F.col("tracker"), F.col("block"))
    return rows.withColumn("label_row", canon_row(F.col("tracker_row"), **(naming or {}))).withColumns({"block": block, "tracker": tracker})


def canon_row(label: Column, motorized: tuple[str, ...] = (), slave: tuple[str, ...] = ()) -> Column:
    """A row label in its common form: motorizada or esclava if listed so, else in lower case; null if empty."""
    t, listed = F.trim(label), lambda names: F.upper(F.trim(label)).isin([n.upper() for n in names])
    return F.when(F.lower(t).isin(*GEOMETRY_ORDER), F.lower(t)).when(listed(motorized), GEOMETRY_ORDER[0]).when(listed(slave), GEOMETRY_ORDER[1]).when(t != "", F.lower(t))


def _keys(df: DataFrame) -> DataFrame:
    joined = lambda *c: F.when(F.greatest(*[F.col(x).isNull() for x in c]) if len(c) > 1 else F.col(c[0]).isNull(), None).otherwise(F.concat_ws("|", *c))
    tiers = (("block", "tracker", "label_row"), ("block", "tracker"), ("tracker", "label_row"), ("tracker",))
    return df.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("tier"), joined(*t).alias("key")) for i, t in enumerate(tiers, 1)]))).where("key IS NOT NULL")


def order_pairs(entries: DataFrame, rows: DataFrame, highest_first: bool = False) -> DataFrame:
    """Row labels and rows of each tracker paired by order where both sides have as many: block, tracker, label_row, row_id, geometry_row, i, n."""
    whole = Window.partitionBy("block", "tracker")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, GEOMETRY_ORDER)), F.col("label_row")), F.lit(0)), F.lit(len(GEOMETRY_ORDER) + 1))
    ours = rows.where("block IS NOT NULL").withColumn("i", F.row_number().over(whole.orderBy(place, "row_ord"))).withColumn("n", F.count("*").over(whole))
    number = F.coalesce(F.nullif(F.regexp_extract("label_row", r"\d+", 0), F.lit("")).cast("double"), F.lit(float("inf")))
    labels = entries.where("block IS NOT NULL AND label_row IS NOT NULL").groupBy("block", "tracker", "label_row").agg(F.min("ord").alias("seen"))
    labels = labels.withColumn("i", F.row_number().over(whole.orderBy(number.desc() if highest_first else number, "seen"))).withColumn("n", F.count("*").over(whole))
    ours = ours.select("block", "tracker", "i", "n", "row_id", "row_ord", F.col("label_row").alias("geometry_row"))
    return labels.join(ours, ["block", "tracker", "i", "n"]).select("block", "tracker", "label_row", "row_id", "row_ord", "geometry_row", "i", "n")


def match_entries(entries: DataFrame, rows: DataFrame, highest_first: bool = False) -> DataFrame:
    """The best of five ways to match entries (ord, block, tracker, label_row) to rows (row_ord, row_id, block, tracker, label_row).

    Keys: block, tracker and row; block and tracker; tracker and row; tracker alone: each counts only where one row has it. Fifth:
    the n-th row label of a tracker goes to its n-th row where both sides have as many. Most matches win, earlier ways tie first.
    Returns tier, ord, row_id. An entry's matches under all tiers are one row, so the winner is counted and kept in one pass.
    """
    entries, rows = entries.select("ord", "block", "tracker", "label_row"), rows.select("row_ord", "row_id", "block", "tracker", "label_row")
    unique = _keys(rows).groupBy("tier", "key").agg(F.count("*").alias("_n"), F.min("row_id").alias("row_id")).where("_n = 1")
    named = _keys(entries).join(unique, ["tier", "key"]).select("tier", "ord", "row_id")
    paired = entries.join(order_pairs(entries, rows, highest_first).select("block", "tracker", "label_row", "row_id"), ["block", "tracker", "label_row"])
    found = named.unionByName(paired.select(F.lit(BY_ORDER).alias("tier"), "ord", "row_id"))
    own = found.groupBy("ord").agg(F.map_from_entries(F.collect_set(F.struct("tier", "row_id"))).alias("by_tier"))  # five at most
    counts = own.agg(*[F.count_if(F.map_contains_key("by_tier", i)).alias(f"_{i}") for i in range(1, BY_ORDER + 1)])
    best = F.array_max(F.array(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("tier")) for i in range(1, BY_ORDER + 1)]))
    tier = counts.select((-best["tier"]).alias("tier"), F.lit(1).alias("_one"))
    chosen = own.withColumn("_one", F.lit(1)).join(F.broadcast(tier), "_one")  # tier has one row
    return chosen.select("tier", "ord", F.col("by_tier")[F.col("tier")].alias("row_id")).where("row_id IS NOT NULL")


def strings_of_rows(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """For each matched row: labels in the order of entries, and the last DC box that is filled. A row has a few strings."""
    own = entries.select("ord", "label", F.nullif(F.col("dc_box"), F.lit("")).alias("dc_box")).join(matches.select("ord", "row_id"), "ord")
    grouped = own.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("all"), F.max_by("dc_box", F.when(F.col("dc_box").isNotNull(), F.col("ord"))).alias("dc_box"))
    return grouped.select("row_id", F.col("all.label").alias("labels"), "dc_box")


def rows_with_box(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """Rows with the DC box of their strings; those without one go."""
    return rows.join(strings.select("row_id", "dc_box").where("dc_box IS NOT NULL"), "row_id")


def apply_strings(rows: DataFrame, strings: DataFrame, chains: DataFrame, field: int) -> DataFrame:
    """Rows with string_numbers and string_labels from number `field` (from 0) of their labels, ascending, and pos and pos_total of their chain.

    Rows without strings or chain keep what they have. A label without such a number counts as 0; equal numbers stay in list order.
    """
    optional = {"string_numbers": "array<double>", "string_labels": "array<string>", "pos": "double", "pos_total": "double"}
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in rows.columns})
    out = rows.join(strings.select("row_id", "labels"), "row_id", "left").join(chains.select("row_id", F.col("pos").alias("_pos"), F.col("pos_total").alias("_total")), "row_id", "left")
    pairs = F.array_sort(F.transform("labels", lambda x, i: F.struct(F.coalesce(F.get(numeric_fields(x), F.lit(field)), F.lit(0.0)).alias("n"), i.alias("i"), x.alias("label"))))
    some = F.size("labels") > 0
    return out.withColumns(
        {
            "string_numbers": F.when(some, F.transform(pairs, lambda p: p["n"])).otherwise(F.col("string_numbers")),
            "string_labels": F.when(some, F.transform(pairs, lambda p: p["label"])).otherwise(F.col("string_labels")),
            "pos": F.coalesce(F.col("_pos").cast("double"), F.col("pos").cast("double")),
            "pos_total": F.coalesce(F.col("_total").cast("double"), F.col("pos_total").cast("double")),
        }
    ).drop("labels", "_pos", "_total")


def match_report(entries: DataFrame, rows: DataFrame, matches: DataFrame, highest_first: bool = False) -> DataFrame:
    """One row: tier (1 without any match), matched, total, rows_with_strings, coverage (percent), low (under 90 of them), examples.

    unmatched: the first entries without a row; shown: the first entries as they were read; pairs: of trackers with more than one
    row, how the labels were paired by order, where that won. The examples are top-k by order.
    """
    tied = entries.join(matches.select("ord", "row_id"), "ord", "left").withColumn("name", F.concat_ws(" ", "tracker", "tracker_row"))
    listed = lambda df, k, *c: df.orderBy(c[0]).limit(k).agg(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[1]]).alias("list"))
    unmatched = listed(tied.where("row_id IS NULL").withColumn("text", F.concat("name", F.lit(" → "), "label")), UNMATCHED, "ord", "text").select(F.col("list").alias("unmatched"))
    read = F.concat_ws(" · ", F.coalesce("block", F.lit("?")), "tracker_no", F.coalesce("label_row", F.lit("?")))
    shown = listed(entries.withColumn("text", F.concat_ws(" = ", F.concat_ws(" ", "tracker", "tracker_row"), read)), SHOWN, "ord", "text").select(F.col("list").alias("shown"))
    counts = tied.agg(F.coalesce(F.count("row_id"), F.lit(0)).alias("matched"), F.count("*").alias("total"), F.count_distinct("row_id").alias("rows_with_strings"))
    facts = matches.agg(F.coalesce(F.max("tier"), F.lit(1)).alias("tier"))
    keyed = entries.select("ord", "block", F.col("tracker_no").alias("tracker"), "label_row")
    each = order_pairs(keyed, rows, highest_first).where("n > 1").groupBy("block", "tracker").agg(F.min("row_ord").alias("seen"), F.array_sort(F.collect_list(F.struct("i", F.concat("label_row", F.lit(" → "), F.coalesce("geometry_row", F.lit("?"))).alias("pair")))).alias("own"))
    each = each.withColumn("text", F.concat_ws(": ", F.concat_ws("-", "block", "tracker"), F.array_join(F.transform("own", lambda x: x["pair"]), ", ")))
    pairs = listed(each, PAIRS, "seen", "text").select(F.col("list").alias("pairs"))
    there = rows.agg(F.count("*").alias("_rows"))
    one = lambda df: F.broadcast(df.withColumn("_one", F.lit(1)))  # noqa: E731  each has one row
    out = facts.withColumn("_one", F.lit(1))
    for df in (counts, unmatched, shown, pairs, there):
        out = out.join(one(df), "_one")
    out = out.withColumn("pairs", F.when(F.col("tier") == BY_ORDER, F.col("pairs")))
    coverage = F.floor(F.col("rows_with_strings") * 100 / F.greatest("_rows", F.lit(1)) + 0.5).cast("int")
    return out.withColumn("coverage", coverage).withColumn("low", F.col("rows_with_strings") < 0.9 * F.col("_rows")).drop("_one", "_rows")


def chain_shapes(report: DataFrame) -> DataFrame:
    """One row: DC boxes in a chain, beside each other, and mixed."""
    return report.agg(*[F.count_if(F.col("shape") == x).alias(x) for x in ("cadena", "paralelas", "mixta")])


def label_fields(labels: DataFrame) -> DataFrame:
    """What the numbers in the first LABELS labels (ord, label) look like: field from 0, distinct values, and the smallest of them."""
    head = labels.orderBy("ord").limit(LABELS).select(F.posexplode(numeric_fields(F.col("label"))).alias("field", "n"))
    return head.groupBy("field").agg(F.array_sort(F.collect_set("n")).alias("_all")).select("field", F.size("_all").alias("n_distinct"), F.slice("_all", 1, VALUES).alias("smallest"))
