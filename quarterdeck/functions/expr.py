"""Small column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_true(condition: Column) -> Column:
    """A comparison with a missing side counts as false (safe to negate)."""
    return F.coalesce(condition, F.lit(False))


def where(value: Column, condition: Column) -> Column:
    """``value`` where the condition holds, else null."""
    return F.when(condition, value)


def blank_where(value: Column, condition: Column) -> Column:
    """Null where the condition holds; a condition that cannot be evaluated keeps the value."""
    return F.when(~is_true(condition), value)


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def flag(condition: Column, applicable: Column) -> Column:
    """1.0 / 0.0 where the rule applies, null where it does not."""
    return F.when(is_true(applicable), is_true(condition).cast("double"))


def day_number(date_column: str | Column) -> Column:
    return F.unix_date(date_column)


def too_small(denominator: Column, reference: Column, ratio: float) -> Column:
    """Denominator below ``ratio`` of the reference scale; unknown reference never fires."""
    return is_true(F.abs(denominator) < F.lit(ratio) * F.abs(reference))


def harmonic_mean(value: Column) -> Column:
    """Aggregate: harmonic mean of the positive values, null when there are none."""
    usable = positive(value)
    return F.try_divide(F.count(usable).cast("double"), F.sum(F.lit(1.0) / usable))


def by_ticker(*extra: str) -> "Window":
    return Window.partitionBy("ticker", *extra).orderBy("day")


def filled_reference(reference: Column, window) -> Column:
    """Last known reference so far; before the first one, the first one to come."""
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.last(reference, ignorenulls=True).over(so_far),
                      F.first(reference, ignorenulls=True).over(everything))


def with_year_ago(df: DataFrame, window, values: Mapping[str, str], periods: int,
                  tolerance_days_per_year: float) -> DataFrame:
    """For each ``source -> result``: the source value of the row nearest to a year back.

    ``window`` orders by day number; "a year" is ``periods`` quarters.  The nearest row is
    either the last one at or before the target date or the first one after it, so two
    bounded frames serve all sources.  An exact tie goes to the earlier row.
    """
    target = periods * 365.25 / 4
    slack = periods * tolerance_days_per_year / 4
    far, near = math.floor(target + slack), math.ceil(target - slack)
    split = math.ceil(target)
    row = F.struct("day", *values)
    found = df.withColumns({
        "_older": F.last(row).over(window.rangeBetween(-far, -split)),
        "_newer": F.first(row).over(window.rangeBetween(-(split - 1), -near)),
    })
    nearest = F.expr(
        f"CASE WHEN _newer IS NULL THEN _older WHEN _older IS NULL THEN _newer "
        f"WHEN abs(day - _older.day - {target}D) <= abs(day - _newer.day - {target}D) "
        f"THEN _older ELSE _newer END")
    return (found.withColumn("_before", nearest)
            .withColumns({result: F.col(f"_before.{source}") for source, result in values.items()})
            .drop("_older", "_newer", "_before"))
