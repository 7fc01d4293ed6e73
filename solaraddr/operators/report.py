"""Findings of a flight, their review and report; field checks and what they prove; cards of farms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .checks import check_summary
from .locate import address_text, warnings
from .tables import csv_cell

#: Candidates that a finding keeps.
KEPT = 8
# Thermography classes with their meaning, and kinds of anomaly.
CLASSES = ((1, "Class 1: no anomaly"), (2, "Class 2: scheduled repair"), (3, "Class 3: immediate action"))
ANOMALIES = (
    "Punto caliente", "Celda multiple", "Diodo de bypass", "String completo", "Modulo completo", "PID", "Suciedad", "Sombra",
    "Caja de conexion", "Vidrio roto", "Otro",
)
# The report's columns, in order.
CSV_COLUMNS = (
    "archivo", "fecha", "latitud", "longitud", "precision_m", "bloque", "tracker", "fila", "string", "modulo", "conteo_desde",
    "modulo_corregido", "confianza", "anomalia", "clase", "delta_t", "estado", "nota", "avisos",
)
RULES = ("near_dc", "far_end", "sides")


def thermal_classes(spark) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), "klass int, meaning string")


def anomaly_kinds(spark) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(ANOMALIES, 1)], "place int, anomaly string")


def finding_id(n: Column) -> Column:
    """An id from a running number: the number in base 36, a hyphen, and a remainder of its product with a constant."""
    return F.concat(F.lower(F.conv(n.cast("string"), 10, 36)), F.lit("-"), F.pmod(n.cast("long") * F.lit(2654435761), F.lit(65535)).cast("string"))


def findings(photos: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """A finding for each located photo: its place, the best address, the first KEPT candidates and the warnings; status pendiente.

    photos: fix_id, file_name, lat, lon, accuracy, taken_at. found: candidates of `locate`. rows: row_id, block, tracker,
    tracker_row (each id once). A photo without a row in range has a null address and the warning no-row-within-range.
    """
    named = found.where(F.col("rank") <= KEPT).join(rows.select("row_id", "block", "tracker", "tracker_row"), "row_id")
    address = F.struct("rank", "row_id", "block", "tracker", "tracker_row", "string_number", "string_label", "module", "counted_from", "position", "confidence", F.col("module_distance").alias("distance"))
    lists = named.groupBy("fix_id").agg(F.array_sort(F.collect_list(address)).alias("candidates"))  # at most KEPT
    out = photos.join(lists, "fix_id", "left").join(warnings(found), "fix_id", "left")
    none = F.col("candidates").isNull()
    return out.withColumns(
        {
            "address": F.get("candidates", F.lit(0)),
            "candidates": F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)),
            "codes": F.when(none, "no-row-within-range").otherwise(F.coalesce("codes", F.lit(""))),
            "status": F.lit("pendiente"),
        }
    )


def patched(found: DataFrame, patches: DataFrame, key: str = "fix_id") -> DataFrame:
    """Findings with the changes of `patches` (key and changed columns; null leaves a column as it is). One patch for each key."""
    changed = [c for c in patches.columns if c != key]
    new = patches.select(key, *[F.col(c).alias(f"_{c}") for c in changed])
    return found.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in changed}).drop(*[f"_{c}" for c in changed])


def reviewed(found: DataFrame, edits: DataFrame, key: str = "fix_id") -> DataFrame:
    """Findings after a review: edits (key, status, klass, delta_t, module_fixed, anomaly, note) as a person ticks them.

    A status, class or module that is ticked again goes back: to pendiente, or to none. A temperature of 0 and empty text mean none.
    Findings without an edit stay.
    """
    toggled = {"status": "pendiente", "klass": None, "module_fixed": None}
    set_to = {"delta_t": F.lit(0.0), "anomaly": F.lit(""), "note": F.lit("")}
    new = edits.select(key, *[F.col(c).alias(f"_{c}") for c in edits.columns if c != key])
    out, there = found.join(new, key, "left"), {}
    for c in edits.columns:
        if c == key:
            continue
        edit = F.col(f"_{c}")
        if c in toggled:
            there[c] = F.when(edit.isNull(), F.col(c)).when(edit == F.col(c), F.lit(toggled[c]).cast(found.schema[c].dataType)).otherwise(edit)
        else:
            there[c] = F.when(edit.isNull(), F.col(c)).otherwise(F.nullif(edit, set_to[c]))
    return out.withColumns(there).drop(*[f"_{c}" for c in there])


def view(found: DataFrame, which: str) -> DataFrame:
    """Findings of a view: todos, sin-ubicar (without an address), or those with a status."""
    if which == "todos":
        return found
    return found.where(F.col("address").isNull() if which == "sin-ubicar" else F.col("status") == which)


def correction_choices(candidates: Column, address: Column) -> Column:
    """The modules that may correct an address: those of its row and string among the candidates, ascending, each once."""
    own = F.filter(candidates, lambda c: (c["row_id"] == address["row_id"]) & (c["string_number"] == address["string_number"]))
    return F.array_sort(F.array_distinct(F.transform(own, lambda c: c["module"])))


def inspection_summary(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of findings, on the whole or for each of `keys`: total, by status, unlocated, by class (zeros too), and distinct blocks."""
    by = found.groupBy(*keys)
    status = {"pending": "pendiente", "confirmed": "confirmado", "discarded": "descartado"}
    return by.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == v).alias(k) for k, v in status.items()],
        F.count_if(F.col("address").isNull()).alias("unlocated"),
        *[F.count_if(F.col("klass") == k).alias(f"class_{k}") for k, _ in CLASSES],
        F.count_distinct("address.block").alias("blocks"),
    )


def report_rows(found: DataFrame) -> DataFrame:
    """The report's lines: CSV_COLUMNS as text for all findings but discarded ones, with their key columns `fix_id` and `line`."""
    a = F.col("address")
    number = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    cells = (
        F.col("file_name"), F.col("taken_at"), fixed(F.col("lat"), 7), fixed(F.col("lon"), 7), number(F.col("accuracy")), a["block"], a["tracker"], a["tracker_row"], number(a["string_number"]), a["module"],
        F.when(a["counted_from"] == "near-dc", "caja DC").when(a["counted_from"].isNotNull(), "punta lejana"), F.col("module_fixed"),
        F.when(a.isNotNull(), F.concat(F.floor(a["confidence"] * 100 + 0.5).cast("string"), F.lit("%"))), F.col("anomaly"), F.col("klass"), number(F.col("delta_t")), F.col("status"), F.col("note"),
        F.replace("codes", F.lit(","), F.lit(" ")),
    )
    out = found.where("status <> 'descartado'").select("fix_id", *[csv_cell(c).alias(n) for c, n in zip(cells, CSV_COLUMNS, strict=True)])
    return out.withColumn("line", F.concat_ws(",", *CSV_COLUMNS))


def write_report(found: DataFrame, path: str, order: str = "fix_id") -> None:
    """The report as one text file: a header, then lines in the order of `order`, dealt into ranges that tasks write; no line feed at the end."""
    from ..sources.report import write_document

    write_document(report_rows(found).orderBy(order).select("line"), path, ",".join(CSV_COLUMNS))


def check_records(best: DataFrame, verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """Field checks from the best module of each fix and what a person found there.

    best: fix_id, row_id, string_number, module, counted_from (rank 1 of `locate`); fixes without one make no record. verdicts:
    fix_id, at, outcome, counted, accuracy, note; the counted module stays for mismatches, if it is a number above 0. rows: row_id,
    block, tracker, tracker_row, side.
    """
    out = best.join(verdicts, "fix_id").join(rows.select("row_id", "block", "tracker", "tracker_row", F.nullif("side", F.lit("")).alias("side")), "row_id", "left")
    counted = F.when((F.col("outcome") == "mismatch") & (F.col("counted") > 0) & ~F.isnan(F.col("counted").cast("double")), F.col("counted"))
    said = address_text(F.col("block"), F.col("tracker"), F.col("tracker_row"), F.col("string_number"), F.col("module"), F.col("counted_from"))
    key = F.concat_ws("-", F.col("at"), "row_id")
    return out.select(key.alias("check_id"), "fix_id", "at", said.alias("said"), "row_id", "block", "tracker", "tracker_row", "string_number", "module", "counted_from", "side", "outcome", "accuracy", counted.alias("counted_module"), F.nullif("note", F.lit("")).alias("note"))


def calibration(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for a farm's profile: status, verified (a line for each match), unverified (mismatches, then rules not covered).

    checks also have at and said; lines come by (at, check_id). The lists go into one profile, so they have to fit one row.
    """
    day = F.left("at", F.lit(10))
    line = F.when(F.col("outcome") == "match", F.concat("said", F.lit(" ("), day, F.lit(")")))
    wrong = F.when(
        F.col("outcome") == "mismatch",
        F.concat(F.lit("UNEXPLAINED: "), "said", F.lit(", counted "), F.coalesce(F.col("counted_module").cast("string"), F.lit("another")), F.lit(" ("), day, F.lit(")"), F.coalesce(F.concat(F.lit(": "), "note"), F.lit(""))),
    )
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("at", "check_id", c.alias("line"))))), lambda x: x["line"])
    lines = checks.agg(listed(line).alias("verified"), listed(wrong).alias("wrong"), F.lit(1).alias("_one"))
    facts = check_summary(checks, rows).withColumn("_one", F.lit(1))
    missing = F.filter(F.array(*[F.when(~F.col(r), F.lit(f"rule not covered: {r}")) for r in RULES]), lambda x: x.isNotNull())
    return facts.join(F.broadcast(lines), "_one").select("status", "verified", F.concat("wrong", missing).alias("unverified"))  # one row


def farm_cards(rows: DataFrame, key: str = "farm_id") -> DataFrame:
    """For each farm: rows, distinct blocks, and the percentages with string numbers and with a place in a chain."""
    share = lambda c: F.floor(F.count_if(c) * 100 / F.count("*") + 0.5).cast("int")
    return rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"),
        share(F.size("string_numbers") > 0).alias("strings_percent"), share(F.col("pos").isNotNull() & F.col("pos_total").isNotNull()).alias("chain_percent"),
    )


# How many of each a screen shows.
SHOWN = {"preview rows": 6, "warnings": 8, "collisions": 5, "chain reports": 12, "mismatches": 4, "photo problems": 5}


def shown(rows: DataFrame, what: str, *order) -> DataFrame:
    """The first rows by `order`, as many as a screen shows of `what` (see SHOWN)."""
    return rows.orderBy(*order).limit(SHOWN[what])


def last_mismatches(checks: DataFrame, most: int = SHOWN["mismatches"]) -> DataFrame:
    """The latest mismatches, newest first."""
    return checks.where("outcome = 'mismatch'").orderBy(F.desc("at"), F.desc("check_id")).limit(most)


def ranked_pick(found: DataFrame, most: int = 12) -> DataFrame:
    """The candidates of each fix that a screen shows."""
    return found.where(F.col("rank") <= most)
