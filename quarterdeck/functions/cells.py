"""Arithmetic that keeps "the row exists" apart from "the value is known".

In the wide frame a concept is one double column with three states: null means the period
has no such row, ``MISSING`` means the row exists but carries no number, anything else is
the value.  A derived cell exists where all of its inputs exist, which is what an inner join
of the long rows would give, without joining anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck.functions.expr import blank_where, positive

MISSING = float("-inf")


_MISSING_SQL = "double('-infinity')"


def _column(part: str | Column) -> Column:
    return F.expr(part) if isinstance(part, str) else part


@dataclass(frozen=True)
class Cell:
    """Value and existence, each SQL text as long as nothing but cells went into it.

    Text is turned into a column once, at the end, which keeps plans with hundreds of cells
    cheap to build.
    """

    _value: str | Column
    _exists: str | Column

    @staticmethod
    def of(name: str) -> "Cell":
        return Cell(f"CASE WHEN `{name}` > {_MISSING_SQL} THEN `{name}` END",
                    f"`{name}` IS NOT NULL")

    @staticmethod
    def where_known(value: Column) -> "Cell":
        """A cell that exists exactly where its value is known (flags)."""
        return Cell(value, value.isNotNull())

    @property
    def value(self) -> Column:
        return _column(self._value)

    @property
    def exists(self) -> Column:
        return _column(self._exists)

    def encoded(self) -> Column:
        if self._is_text():
            return F.expr(f"CASE WHEN {self._exists} THEN coalesce({self._value}, {_MISSING_SQL}) END")
        return F.when(self.exists, F.coalesce(self.value, F.lit(MISSING)))

    def _is_text(self) -> bool:
        return isinstance(self._value, str) and isinstance(self._exists, str)

    def _combined(self, other: "Cell", text: str, build) -> "Cell":
        if self._is_text() and other._is_text():
            return Cell(text.format(self._value, other._value),
                        f"{self._exists} AND {other._exists}")
        return Cell(build(self.value, other.value), self.exists & other.exists)

    def __add__(self, other: "Cell") -> "Cell":
        return self._combined(other, "({} + {})", lambda a, b: a + b)

    def __sub__(self, other: "Cell") -> "Cell":
        return self._combined(other, "({} - {})", lambda a, b: a - b)

    def __truediv__(self, other: "Cell") -> "Cell":
        return self._combined(other, "try_divide({}, {})", F.try_divide)

    def times(self, factor: float) -> "Cell":
        if self._is_text():
            return Cell(f"({self._value} * {float(factor)}D)", self._exists)
        return Cell(self.value * F.lit(factor), self.exists)

    def if_positive(self) -> "Cell":
        if self._is_text():
            return Cell(f"CASE WHEN {self._value} > 0 THEN {self._value} END", self._exists)
        return Cell(positive(self.value), self.exists)

    def blank(self, condition: Column) -> "Cell":
        return Cell(blank_where(self.value, condition), self._exists)


def encode(value: Column) -> Column:
    """A known-or-missing value of an existing row as a wide-frame state."""
    return F.coalesce(value, F.lit(MISSING))


def decode(name: str) -> Column:
    return Cell.of(name).value
