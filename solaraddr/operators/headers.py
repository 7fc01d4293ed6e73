"""Which column of a sheet is which: headers found, read as coordinates, and mapped to fields.

Headers are metadata of a few dozen words, so the mapping itself is made where the query is put together; `coordinate_role` is the
same reading as a column expression, for headers that are data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_words

#: Rows of a sheet whose cells tell which headers it has.
HEAD_ROWS = 200
# Words that name an axis, compass words that do so for want of others, and words for the first and the second stake.
AXES = {"y": ("lat", "latitud", "latitude", "northing", "y"), "x": ("lon", "lng", "long", "longitud", "longitude", "easting", "x")}
COMPASS = {"y": ("norte", "north", "n"), "x": ("este", "east", "e")}
FIRST = ("1", "a", "inicio", "ini", "start", "desde", "from", "norte", "north")
SECOND = ("2", "b", "fin", "final", "end", "hasta", "to", "sur", "south")
# Words that name the other fields, the likeliest set first; all of a set have to occur.
FIELD_WORDS = {
    "block": ("bloque", "block", "bl", "sector"),
    "tracker": ("tracker", "seguidor", "trk", "mesa"),
    "tracker_row": ("motor row", "row", "fila"),
    "side": ("lado", "side"),
    "pos": ("pos", "posicion", "position", "orden"),
    "pos_total": ("pos total", "total trackers", "largo linea"),
    "string_numbers": ("strings", "string", "cadenas", "cadena"),
}
STRING_WORDS = {
    "label": ("string", "cadena", "codigo string"),
    "tracker": ("tracker", "seguidor", "mesa"),
    "tracker_row": ("row", "fila"),
    "dc_box": ("dc box", "dcb", "caja dc", "combiner", "caja"),
}


def headers_of(cells: DataFrame) -> DataFrame:
    """sheet, header and place (from 1) of the headers in the first HEAD_ROWS rows of (sheet, ord, cells), by first appearance."""
    found = cells.where(F.col("ord") < HEAD_ROWS).select("sheet", "ord", F.posexplode(F.map_keys("cells")).alias("at", "header"))
    first = found.groupBy("sheet", "header").agg(F.min(F.struct("ord", "at")).alias("seen"))
    ordered = first.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("seen", "header"))).alias("all"))  # some dozens a sheet
    return ordered.select("sheet", F.posexplode("all").alias("place", "h")).select("sheet", "h.header", (F.col("place") + 1).alias("place"))


def coordinate_role(header: Column) -> Column:
    """start_x, start_y, end_x or end_y of a header that names an axis and a stake; null for others.

    Words for an axis decide; compass words only where there are none of those; words for both axes decide nothing. Once one word
    has named the axis, the others name the stake, and words for the second stake go before those for the first.
    """
    among = lambda words, known: F.arrays_overlap(words, F.array(*map(F.lit, known)))

    def of_words(words: Column) -> Column:
        sy, sx, cy, cx = among(words, AXES["y"]), among(words, AXES["x"]), among(words, COMPASS["y"]), among(words, COMPASS["x"])
        axis = F.when(sy & sx, None).when(sy, "y").when(sx, "x").when(cy & cx, None).when(cy, "Y").when(cx, "X")
        return _with(axis, lambda axis: F.when(axis.isNotNull(), of_axis(words, axis)))

    def of_axis(words: Column, axis: Column) -> Column:
        names = F.when(axis == "y", F.array(*map(F.lit, AXES["y"]))).when(axis == "x", F.array(*map(F.lit, AXES["x"]))).when(axis == "Y", F.array(*map(F.lit, COMPASS["y"]))).otherwise(F.array(*map(F.lit, COMPASS["x"])))
        spent = _with(names, lambda names: F.array_position(F.transform(words, lambda w: F.array_contains(names, w)), True))
        others = _with(spent, lambda at: F.filter(words, lambda w, i: i != at - 1))
        stake = _with(others, lambda rest: F.when(among(rest, SECOND), "end").when(among(rest, FIRST), "start"))
        return F.concat(stake, F.lit("_"), F.lower(axis))

    return _with(header_words(header), of_words)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(header: str, split_digits: bool = True) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", header.lower()) if not unicodedata.combining(c))
    return re.findall(r"[a-z]+|\d+" if split_digits else r"[a-z0-9]+", plain)


def _role(words: list[str]) -> str | None:
    for table in (AXES, COMPASS):
        axes = [a for a in "yx" if set(table[a]) & set(words)]
        if axes:
            break
    if len(axes) != 1:
        return None
    spent = next(i for i, w in enumerate(words) if w in table[axes[0]])
    others = {w for i, w in enumerate(words) if i != spent}
    stake = "end" if others & set(SECOND) else "start" if others & set(FIRST) else None
    return stake and f"{stake}_{axes[0]}"


def _by_words(headers: list[str], table: dict[str, tuple[str, ...]], found: dict[str, str], split_digits: bool) -> dict[str, str]:
    for field, sets in table.items():
        for words in sets:
            free = (h for h in headers if h not in found.values() and set(words.split()) <= set(_words(h, split_digits)))
            if field not in found and (hit := next(free, None)) is not None:
                found[field] = hit
    return found


def suggest_fields(headers: list[str]) -> dict[str, str]:
    """Field -> header for a sheet of stakes: coordinates first, each field its first header, then the others by their words; no header twice."""
    found: dict[str, str] = {}
    for h in headers:
        if (role := _role(_words(h))) is not None:
            found.setdefault(role, h)
    return _by_words(headers, FIELD_WORDS, found, True)


def suggest_string_fields(headers: list[str]) -> dict[str, str]:
    """Field -> header for a list of strings."""
    return _by_words(headers, STRING_WORDS, {}, False)


def renamed(cells: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A column for each field, from the cells (sheet, ord, cells: map) or from columns of a table; missing ones are null."""
    pick = (lambda h: F.col("cells")[h]) if "cells" in cells.columns else (lambda h: F.col(f"`{h}`"))
    keep = [c for c in ("sheet", "ord") if c in cells.columns]
    return cells.select(*keep, *[pick(h).alias(f) for f, h in fields.items()])
