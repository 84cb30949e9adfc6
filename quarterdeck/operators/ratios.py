"""Ratios, sums and differences of concepts on the long frame.

Each call reads the concepts it needs in one aggregation by ``(ticker, end)``; nothing is
joined.  A result row exists where every input row exists, even if a value is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.cells import Cell, encode
from quarterdeck.functions.expr import by_ticker, filled_reference, too_small
from quarterdeck.operators.timeseries import with_day


def pivot_states(long: DataFrame, concepts: Sequence[str], value: str = "value") -> DataFrame:
    """Wide frame in the encoding of ``functions.cells``: one column per concept."""
    wanted = long.filter(F.col("concept").isin(*concepts))
    return wanted.groupBy("ticker", "end").agg(*[
        F.max(F.when(F.col("concept") == c, encode(F.col(value)))).alias(c) for c in concepts])


def _finish(wide: DataFrame, cell: Cell, result: str) -> DataFrame:
    return wide.filter(cell.exists).select("ticker", "end", cell.value.alias(result))


def calculate_ratio(facts: DataFrame, numerator: str, denominator: str, result: str,
                    require_positive_denominator: bool = False,
                    scale_reference: str | None = None,
                    scale_ratio: float | None = None) -> DataFrame:
    concepts = list(dict.fromkeys(
        c for c in (numerator, denominator, scale_reference) if c is not None))
    wide = pivot_states(facts, concepts)
    above, below = Cell.of(numerator), Cell.of(denominator)
    if require_positive_denominator:
        below = below.if_positive()
    ratio = above / below
    if scale_reference is None or scale_ratio is None:
        return _finish(wide, ratio, result)
    # the reference is carried across the periods of this ratio only
    both = with_day(wide.filter(ratio.exists))
    both = both.withColumn("_scale", filled_reference(Cell.of(scale_reference).value, by_ticker()))
    return _finish(both, ratio.blank(too_small(below.value, F.col("_scale"), scale_ratio)), result)


def calculate_difference(facts: DataFrame, first: str, second: str, result: str,
                         sign: str = "-") -> DataFrame:
    wide = pivot_states(facts, [first, second])
    a, b = Cell.of(first), Cell.of(second)
    return _finish(wide, a + b if sign == "+" else a - b, result)


def ratio_of_frames(numerator: DataFrame, denominator: DataFrame, above: str, below: str,
                    result: str, min_denominator_abs: float | None = None,
                    max_abs_result: float | None = None) -> DataFrame:
    both = numerator.select("ticker", "end", above).join(
        denominator.select("ticker", "end", below), ["ticker", "end"])
    value = F.try_divide(F.col(above), F.col(below))
    if min_denominator_abs is not None:
        value = F.when(F.abs(below) >= min_denominator_abs, value)
    if max_abs_result is not None:
        value = F.when(F.abs(value) <= max_abs_result, value)
    return both.select("ticker", "end", value.alias(result))


def sum_of_frames(left: DataFrame, right: DataFrame, a: str, b: str, result: str) -> DataFrame:
    return (left.select("ticker", "end", a).join(right.select("ticker", "end", b),
                                                 ["ticker", "end"])
            .select("ticker", "end", (F.col(a) + F.col(b)).alias(result)))


def difference_of_frames(left: DataFrame, right: DataFrame, a: str, b: str,
                         result: str) -> DataFrame:
    return (left.select("ticker", "end", a).join(right.select("ticker", "end", b),
                                                 ["ticker", "end"])
            .select("ticker", "end", (F.col(a) - F.col(b)).alias(result)))
