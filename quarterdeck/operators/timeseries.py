"""Calendar-checked windows over the quarterly series of a company.

A series is one ``(ticker, concept)`` with at most one row per period end, so however
many raw rows lie behind it, a window partition never exceeds the number of calendar days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.expr import (
    by_ticker, day_number, filled_reference, is_true, positive, with_year_ago,
)
from quarterdeck.session import dealt_by_rows

SERIES = ("ticker", "concept")


def with_day(df: DataFrame, column: str = "end") -> DataFrame:
    return df.withColumn("day", day_number(column))


def series_window():
    return by_ticker("concept")


def with_trailing_year_sum(df: DataFrame, value: str, result: str, window=None) -> DataFrame:
    """Sum of four rows, given only when they are four adjacent quarters of one year."""
    window = window or series_window()
    staged = df.withColumns({
        **{f"_value{k}": F.lag(value, k).over(window) for k in (1, 2, 3)},
        **{f"_day{k}": F.lag("day", k).over(window) for k in (1, 2, 3)}})
    low, high = K.TTM_STEP_DAYS
    covers_a_year = F.expr(
        f"day - _day1 BETWEEN {low} AND {high} "
        f"AND _day1 - _day2 BETWEEN {low} AND {high} AND _day2 - _day3 BETWEEN {low} AND {high} "
        f"AND day - _day3 BETWEEN {K.TTM_SPAN_DAYS[0]} AND {K.TTM_SPAN_DAYS[1]}")
    # from the oldest on, as a sum adds them; one missing value leaves none
    total = F.lit(0) + F.col("_value3") + F.col("_value2") + F.col("_value1") + F.col(value)
    return (staged.withColumn(result, F.when(covers_a_year, total))
            .drop(*[f"_{name}{k}" for name in ("value", "day") for k in (1, 2, 3)]))


def with_growth(df: DataFrame, values: Mapping[str, str], window=None,
                min_base: Column | float = K.GROWTH_MIN_BASE_RATIO, periods: int = 4) -> DataFrame:
    """Growth against the row a year back; null across zero or from a tiny base.

    ``values`` maps a value column to the name of its growth column.
    """
    before = {source: f"_before_{source}" for source in values}
    staged = with_year_ago(df, window or series_window(), before, periods,
                           K.GROWTH_TOLERANCE_DAYS_PER_YEAR)
    staged = staged.withColumn(
        "_floor", min_base if isinstance(min_base, Column) else F.lit(float(min_base)))
    grown = {
        result: F.expr(f"CASE WHEN {before[v]} > 0 AND {v} > 0 AND {before[v]} >= _floor * {v} "
                       f"THEN {v} / {before[v]} - 1 END")
        for v, result in values.items()}
    return staged.withColumns(grown).drop("_floor", *before.values())


def calculate_ttm(facts: DataFrame, concept: str, result: str) -> DataFrame:
    rows = with_day(facts.filter(F.col("concept") == concept))
    return with_trailing_year_sum(rows, "value", result).select("ticker", "end", result)


def calculate_growth(facts: DataFrame, concept: str, periods: int, result: str,
                     min_base_ratio: float = K.GROWTH_MIN_BASE_RATIO) -> DataFrame:
    rows = with_day(facts.filter(F.col("concept") == concept))
    grown = with_growth(rows, {"value": result}, min_base=min_base_ratio, periods=periods)
    return grown.select("ticker", "end", "value", result)


def add_ttm_concepts(facts: DataFrame, concepts: Sequence[str] = K.TTM_CONCEPTS) -> DataFrame:
    """Append ``<concept>_TTM`` rows; only a row with a number claims its derivation.

    One pass: each row of a listed concept yields itself and its TTM row.  Where an annual
    fact already supplies the TTM row of a period, the empty rolling row gives way to it.
    A concept travels with its TTM rows, once.  ``facts`` are read twice, first for their number.
    """
    if "ttm_source" not in facts.columns:
        facts = facts.withColumn("ttm_source", F.lit(None).cast("string"))
    stem = F.when(F.col("concept").endswith("_TTM"), F.regexp_replace("concept", "(_TTM)+$", "")).otherwise(F.col("concept"))
    family = with_day(facts).withColumn("_family", stem)
    rows = with_trailing_year_sum(dealt_by_rows(family, facts.count(), "ticker", "_family"), "value", "_ttm",
                                  by_ticker("_family", "concept"))
    itself = F.struct(F.col("concept"), F.col("value"), F.col("ttm_source"))
    derived = F.struct(
        F.concat("concept", F.lit("_TTM")).alias("concept"),
        F.col("_ttm").alias("value"),
        F.when(F.col("_ttm").isNotNull(), F.lit(K.TTM_ROLLING)).alias("ttm_source"))
    listed = F.col("concept").isin(*concepts)
    rows = rows.select("ticker", "_family", "end", F.inline(
        F.when(listed, F.array(itself, derived)).otherwise(F.array(itself))))
    annual = F.col("ttm_source") == K.TTM_ANNUAL
    return rows.groupBy("ticker", "_family", "concept", "end").agg(
        F.max("value").alias("value"),
        F.max(F.when(annual, 2).when(F.col("ttm_source").isNotNull(), 1)).alias("_source"),
    ).select("ticker", "concept", "end", "value",
             F.when(F.col("_source") == 2, K.TTM_ANNUAL)
             .when(F.col("_source") == 1, K.TTM_ROLLING).alias("ttm_source"))


def growth_excluded() -> list[str]:
    return [name for c in K.GROWTH_EXCLUDED_CONCEPTS for name in (c, f"{c}_TTM")]


def growth_base_ratio() -> Column:
    return F.when(F.col("concept").isin(*K.GROWTH_LOOSE_BASE_CONCEPTS),
                  F.lit(K.GROWTH_LOOSE_BASE_RATIO)).otherwise(F.lit(K.GROWTH_MIN_BASE_RATIO))


def add_growth_column(facts: DataFrame, column: str = "yoy_growth") -> DataFrame:
    """Year-over-year growth of every series except the two whose sign swings freely."""
    grown = with_growth(with_day(facts), {"value": column}, min_base=growth_base_ratio())
    return (grown.withColumn(column, F.when(~F.col("concept").isin(*growth_excluded()),
                                            F.col(column)))
            .drop("day"))


def quarter_over_quarter(facts: DataFrame, concept: str, name: str) -> DataFrame:
    """Previous row of a series and whether the step is one quarter long."""
    window = series_window()
    rows = with_day(facts.filter(F.col("concept") == concept))
    return rows.select(
        "ticker", "end", F.col("value").alias(name),
        F.lag("value").over(window).alias(f"prev_{name}"),
        F.lag("end").over(window).alias("prev_end"),
        is_true((F.col("day") - F.lag("day").over(window)).between(*K.QOQ_GAP_DAYS))
        .alias("gap_ok"))


def rolling_harmonic_stats(df: DataFrame, value: str, prefix: str,
                           window_days: int = K.FIVE_YEAR_DAYS,
                           keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Harmonic mean, median and count of the positive values in ``(end - window, end]``."""
    frame = (Window.partitionBy(*keys).orderBy("day")
             .rangeBetween(-(window_days - 1), Window.currentRow))
    usable = positive(F.col(value))
    n = F.count(usable).over(frame)
    return with_day(df).select(
        *keys, "end",
        F.try_divide(n.cast("double"), F.sum(F.lit(1.0) / usable).over(frame)).alias(prefix),
        F.percentile(usable, 0.5).over(frame).alias(f"{prefix}_median"),
        n.alias(f"{prefix}_n"))


def latest_row(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """The newest row per key, whether or not it carries a value."""
    values = [c for c in df.columns if c not in (*keys, "end")]
    return df.groupBy(*keys).agg(
        F.max("end").alias("end"), *[F.max_by(c, "end").alias(c) for c in values])


def latest_value(facts: DataFrame, concepts: Sequence[str] | None = None,
                 max_age_days: int | None = K.LATEST_VALUE_MAX_AGE_DAYS) -> DataFrame:
    """Newest known value per series with its distance to the newest row."""
    rows = facts if concepts is None else facts.filter(F.col("concept").isin(*concepts))
    known_end = F.when(F.col("value").isNotNull(), F.col("end"))
    out = rows.groupBy("ticker", "concept").agg(
        F.max(known_end).alias("value_end"),
        F.max_by("value", known_end).alias("value"),
        F.max("end").alias("_newest"),
    ).filter(F.col("value_end").isNotNull())
    out = out.select("ticker", "concept", F.col("value_end").alias("end"), "value",
                     F.datediff("_newest", "value_end").alias("value_age_days"))
    return out if max_age_days is None else out.filter(F.col("value_age_days") <= max_age_days)


def price_as_of(price_history: DataFrame, cutoff) -> DataFrame:
    """Last price row at or before the cutoff date, per company."""
    return (price_history.filter(F.col("date") <= F.lit(cutoff).cast("date"))
            .groupBy("ticker").agg(F.max_by("close", "date").alias("price")))


def trailing_years(df: DataFrame, years: int, as_of, close_at_anchor: bool = True) -> DataFrame:
    """Rows of the trailing ``years`` calendar years; bounded above when asked for a date."""
    anchor = F.lit(as_of).cast("date")
    out = df.filter(F.col("end") >= F.add_months(anchor, -12 * years))
    return out.filter(F.col("end") <= anchor) if close_at_anchor else out


def five_year_window(df: DataFrame, as_of) -> DataFrame:
    """Rows in ``(anchor - 1826 days, anchor]``."""
    anchor = F.lit(as_of).cast("date")
    return df.filter((F.col("end") > F.date_sub(anchor, K.FIVE_YEAR_DAYS))
                     & (F.col("end") <= anchor))


def newest_periods(df: DataFrame, n: int, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows of the ``n`` most recent period ends per key."""
    window = Window.partitionBy(*keys).orderBy(F.col("end").desc())
    return (df.withColumn("_rank", F.dense_rank().over(window))
            .filter(F.col("_rank") <= n).drop("_rank"))


def scale_reference(df: DataFrame, reference: str, result: str) -> DataFrame:
    """Carry a company's scale reference into the periods where it is missing."""
    return (with_day(df).withColumn(result, filled_reference(F.col(reference), by_ticker()))
            .drop("day"))


def self_scale_guard(df: DataFrame, value: str, reference: str,
                     half_window_days: int = K.SELF_SCALE_HALF_WINDOW_DAYS,
                     ratio: float = K.SELF_SCALE_RATIO) -> DataFrame:
    """Blank a value whose own reference collapsed against its neighbours' scale.

    The window looks both ways on purpose, so the guard is not causal.
    """
    around = by_ticker().rangeBetween(-half_window_days, half_window_days)
    size = F.abs(reference)
    collapsed = is_true(size < F.lit(ratio) * F.max(size).over(around))
    return (with_day(df).withColumn(value, F.when(~collapsed, F.col(value))).drop("day"))


def pivot_periods(frame: DataFrame, concepts: Sequence[str], value: str = "value",
                  newest_first: bool = True) -> DataFrame:
    """One row per period, one column per listed concept; all-null columns stay."""
    wide = frame.groupBy("ticker", "end").agg(*[
        F.max(F.when(F.col("concept") == c, F.col(value))).alias(c) for c in concepts])
    return wide.orderBy("ticker", F.col("end").desc()) if newest_first else wide
