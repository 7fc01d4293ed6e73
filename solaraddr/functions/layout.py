"""Modules along a row: n modules a string, strings apart by a gap, all counted from the origin end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Lengths in metres. `offset` is from the stake at the origin to the first module's edge.

    `own_pitch` and `own_offset` are columns where rows differ; see `of_rows`.
    """

    modules: int = 28
    strings: int = 2
    width: float = 1.130
    gap: float = 0.020
    string_gap: float = 3.713
    offset: float = -1.464
    own_pitch: Column | None = None
    own_offset: Column | None = None

    def of_rows(self, pitch: Column, offset: Column) -> Layout:
        return replace(self, own_pitch=pitch, own_offset=offset)

    @property
    def pitch(self):
        return self.width + self.gap if self.own_pitch is None else self.own_pitch

    @property
    def first(self):
        return self.offset if self.own_offset is None else self.own_offset

    @property
    def span(self):
        return self.modules * self.pitch - self.gap

    @property
    def period(self):
        return self.span + self.string_gap

    @property
    def extent(self):
        """From the first module's edge to the last one's."""
        return self.strings * self.span + (self.strings - 1) * self.string_gap

    @property
    def total(self) -> int:
        return self.modules * self.strings

    def chunk(self, position: Column) -> Column:
        return F.floor((position - 1) / self.modules).cast("int")

    def module(self, position: Column, inverted: Column) -> Column:
        within = position - self.chunk(position) * self.modules
        return F.when(inverted, self.modules + 1 - within).otherwise(within).cast("int")

    def position_at(self, distance: Column) -> tuple[Column, Column, Column]:
        """(position, whether it lies in a gap between strings, unclamped position counted from 1)."""
        d = distance - self.first
        s = F.least(F.greatest(F.floor(d / self.period), F.lit(0)), F.lit(self.strings - 1))
        within = d - s * self.period
        position = s * self.modules + F.floor(within / self.pitch) + 1
        clamped = F.least(F.greatest(position, F.lit(1)), F.lit(self.total)).cast("int")
        return clamped, (within > self.span) & (s < self.strings - 1), s * self.modules + within / self.pitch + 1

    def distance_at(self, position: Column) -> Column:
        """The centre of a module."""
        s = self.chunk(position)
        return self.first + s * self.period + (position - s * self.modules - 1) * self.pitch + self.width / 2
