"""Coordinate text as Column expressions: decimal degrees, degrees and minutes, or degrees, minutes and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = "struct<h:string,n:array<string>>"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _with(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _tokens(text: Column) -> Column:
    t = F.regexp_replace(F.upper(text), "[°º*'´`′\"″“”,;]", " ")
    t = F.regexp_replace(t, "([NSEW])", " $1 ")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def _part(h: Column, n: Column) -> Column:
    return F.struct(h.alias("h"), n.alias("n")).cast(_PART)


def _by_letters(tokens: Column) -> Column:
    """Parts that a letter opens or closes, and whether some part has over three numbers."""
    none = F.array().cast("array<string>")
    zero = F.struct(F.array().cast(f"array<{_PART}>").alias("done"), F.lit(None).cast("string").alias("h"), none.alias("n"), F.lit(False).alias("bad"))

    def state(done, h, n, bad):
        return F.struct(done.alias("done"), h.alias("h"), n.alias("n"), bad.alias("bad"))

    def flushed(s):
        return F.when((F.size(s.n) > 0) | s.h.isNotNull(), F.concat(s.done, F.array(_part(s.h, s.n)))).otherwise(s.done)

    def step(s, t):
        closes = s.h.isNull() & (F.size(s.n) > 0)
        letter = F.when(closes, state(F.concat(s.done, F.array(_part(t, s.n))), F.lit(None).cast("string"), none, s.bad)).otherwise(state(flushed(s), t, none, s.bad))
        return F.when(t.rlike("^[NSEW]$"), letter).otherwise(state(s.done, s.h, F.concat(s.n, F.array(t)), s.bad | (F.size(s.n) >= 3)))

    return F.aggregate(tokens, zero, step, lambda s: F.struct(flushed(s).alias("parts"), s.bad.alias("bad")))


def parse_coordinate(text: Column) -> Column:
    """struct(lat, lon, error) of a coordinate in text; error is `syntax` or `range` and both numbers are null then.

    Letters N S E W come before or after their numbers, and a longitude given first is put second. Without letters 2, 4 or 6 numbers
    are halved. A minus sign and a letter S or W each turn the sign. Null text gives a null struct.
    """
    found = _with(_tokens(text), lambda tokens: _with(_parts(tokens), _decided))
    return F.when(text.isNotNull(), found)


def _parts(tokens: Column) -> Column:
    """struct(parts, bad) of the tokens of a text; `bad` for what cannot be two components."""
    lettered = F.exists(tokens, lambda t: t.rlike("^[NSEW]$"))
    wrong = F.exists(tokens, lambda t: ~t.rlike("^[NSEW]$") & ~t.rlike(_NUMBER))
    half = (F.size(tokens) / 2).cast("int")
    even = F.size(tokens).isin(2, 4, 6)
    halves = F.array(*[_part(F.lit(None).cast("string"), F.slice(tokens, a, F.greatest(half, F.lit(0)))) for a in (F.lit(1), half + 1)])
    plain = F.struct(F.when(even, halves).otherwise(F.array().cast(f"array<{_PART}>")).alias("parts"), F.lit(False).alias("bad"))
    found = F.when(lettered, _by_letters(tokens)).otherwise(plain)
    return F.struct(found["parts"].alias("parts"), (found["bad"] | wrong).alias("bad"))


def _decided(found: Column) -> Column:
    def number(p, i):
        return F.coalesce(F.get(p.n, F.lit(i)).try_cast("double"), F.lit(0.0))

    def degrees(p):
        size = F.abs(number(p, 0)) + number(p, 1) / 60 + number(p, 2) / 3600
        sign = F.when(F.get(p.n, F.lit(0)).startswith("-"), -1).otherwise(1) * F.when(p.h.isin("S", "W"), -1).otherwise(1)
        odd = (number(p, 1) < 0) | (number(p, 1) >= 60) | (number(p, 2) < 0) | (number(p, 2) >= 60)
        return F.struct(p.h.alias("h"), (size * sign).alias("value"), odd.alias("odd"))

    def both(d):
        a, b = F.get(d, F.lit(0)), F.get(d, F.lit(1))
        swap = F.coalesce(a.h.isin("E", "W"), F.lit(False)) | F.coalesce(b.h.isin("N", "S"), F.lit(False))
        return F.struct(F.when(swap, b.value).otherwise(a.value).alias("lat"), F.when(swap, a.value).otherwise(b.value).alias("lon"), (a.odd | b.odd).alias("odd"))

    def judged(c):
        error = F.when(found["bad"] | (F.size(found["parts"]) != 2), "syntax").when(c.odd | (F.abs(c.lat) > 90) | (F.abs(c.lon) > 180), "range")
        return _with(error, lambda e: F.struct(F.when(e.isNull(), c.lat).alias("lat"), F.when(e.isNull(), c.lon).alias("lon"), e.alias("error")))

    return _with(F.transform(found["parts"], degrees), lambda d: _with(both(d), judged))
