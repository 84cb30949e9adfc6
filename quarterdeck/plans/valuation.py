"""Valuation multiples over time, their five-year averages and peer comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import Cell
from quarterdeck.functions.expr import blank_where, by_ticker, filled_reference, positive, too_small
from quarterdeck.functions.quantiles import group_median
from quarterdeck.operators.periods import majority_order, with_cluster
from quarterdeck.operators.reshape import unpivot_values
from quarterdeck.operators.timeseries import five_year_window, rolling_harmonic_stats
from quarterdeck.operators.visibility import with_profile
from quarterdeck.plans.wide import CLOSE
from quarterdeck.registry import FIVE_YEAR_FIELDS, HARMONIC_METRICS

NEEDED = (
    "EPS_TTM_CALC", "Revenue_TTM", "StockholdersEquity", "SharesOutstanding", "LongTermDebt",
    "CashAndEquivalents", "DividendsPerShare_TTM", "FCF_TTM", "EBITDA_TTM", "TangibleEquity",
    "PPNR", "CoreOperatingEarnings", "FFO_TTM", "ShareBasedCompensation_TTM",
)
MULTIPLES = (
    "pe_ratio", "pb_ratio", "pfcf_ratio", "ev_fcf", "pfcf_ex_sbc", "ev_ebitda", "ev_sales",
    "dividend_yield", "p_tbv", "p_ppnr", "p_core_earnings", "pe_to_revenue_growth", "p_ffo",
)
HISTORY = (*MULTIPLES, "buyback_distortion_flag")


def over_positive(above: Column, below: Column) -> Column:
    return F.try_divide(above, positive(below))


def scale_guarded(value: Column, denominator: Column, reference: Column) -> Column:
    return blank_where(value, too_small(denominator, reference, K.VALUATION_SCALE_RATIO))


def price_to_growth(pe: Column, growth: Column) -> Column:
    ratio = F.when(growth > K.PEG_MIN_GROWTH, F.try_divide(pe, growth * 100))
    return F.when(F.abs(ratio) <= K.PEG_MAX_ABS, ratio)


def aligned_periods(wide: DataFrame) -> DataFrame:
    """One row per quarter: ends up to a week apart collapse onto the fullest one.

    Within a cluster the later filed end supplies a concept that both carry, and the close
    is the one at the surviving end.
    """
    carried = F.expr(" + ".join(f"int(`{c}` IS NOT NULL)" for c in NEEDED))
    rows = wide.withColumn("n_needed", carried).filter(F.col("n_needed") > 0)
    rows = rows.select("ticker", "end", "day", "n_needed", "g_revenue", CLOSE,
                       "buyback_distortion_flag", "share_count_jump_flag", *NEEDED)
    order = majority_order(F.col("n_needed"))
    newest = [F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN day END) AS `{c}`")
              for c in NEEDED]
    merged = with_cluster(rows).groupBy("ticker", "cluster").agg(
        F.max_by("end", order).alias("end"),
        F.max_by("day", order).alias("day"),
        F.max_by(CLOSE, order).alias("close"),
        F.max_by("share_count_jump_flag", order).alias("suspect"),
        F.max_by("g_revenue", F.when(Cell.of("Revenue_TTM").exists, F.col("day"))).alias("growth"),
        F.max_by("buyback_distortion_flag",
                 F.when(F.col("buyback_distortion_flag").isNotNull(), F.col("day"))
                 ).alias("buyback_distortion_flag"),
        *newest)
    values = merged.withColumns({c: Cell.of(c).value for c in NEEDED})
    return values.filter(F.coalesce(*NEEDED).isNotNull())


def with_multiples(periods: DataFrame, quotes: DataFrame | None) -> DataFrame:
    """Thirteen multiples per aligned period; the suspect-share flag rides along.

    A company without any filed share count falls back to the count of its quote.
    """
    company = Window.partitionBy("ticker")
    shares = F.col("SharesOutstanding")
    if quotes is not None:
        fallback = quotes.select("ticker", F.col("shares_outstanding").alias("_quoted"))
        periods = periods.join(fallback, "ticker", "left")
        shares = F.when(F.count(shares).over(company) > 0, shares).otherwise(F.col("_quoted"))
    base = periods.withColumns({
        "_shares": shares,
        "_scale": filled_reference(F.col("Revenue_TTM"), by_ticker()),
    }).withColumns({
        "market_cap": F.expr("close * _shares"),
        "net_debt": F.expr("LongTermDebt - CashAndEquivalents"),
        "owner_fcf": F.expr("FCF_TTM - ShareBasedCompensation_TTM"),
        "_earnings": F.expr("EPS_TTM_CALC * _shares"),
    }).withColumn("ev", F.expr("market_cap + net_debt"))
    cap, ev, scale = F.col("market_cap"), F.col("ev"), F.col("_scale")

    def guarded(above: Column, below: str) -> Column:
        return scale_guarded(over_positive(above, F.col(below)), F.col(below), scale)

    pe = over_positive(F.col("close"), F.col("EPS_TTM_CALC"))
    multiples = {
        "pe_ratio": scale_guarded(pe, F.col("_earnings"), scale),
        "pb_ratio": blank_where(guarded(cap, "StockholdersEquity"), F.col("TangibleEquity") < 0),
        "pfcf_ratio": guarded(cap, "FCF_TTM"),
        "ev_fcf": guarded(ev, "FCF_TTM"),
        "pfcf_ex_sbc": guarded(cap, "owner_fcf"),
        "ev_ebitda": guarded(ev, "EBITDA_TTM"),
        "ev_sales": over_positive(ev, F.col("Revenue_TTM")),
        "dividend_yield": F.try_divide(
            F.when(F.col("DividendsPerShare_TTM") >= 0, F.col("DividendsPerShare_TTM")),
            F.col("close")),
        "p_tbv": guarded(cap, "TangibleEquity"),
        "p_ppnr": guarded(cap, "PPNR"),
        "p_core_earnings": guarded(cap, "CoreOperatingEarnings"),
        "p_ffo": guarded(cap, "FFO_TTM"),
    }
    out = base.withColumns(multiples)
    return out.withColumn(
        "pe_to_revenue_growth", price_to_growth(F.col("pe_ratio"), F.col("growth")))


def valuation_wide(wide: DataFrame, quotes: DataFrame | None) -> DataFrame:
    return with_multiples(aligned_periods(wide), quotes).select(
        "ticker", "end", "suspect", *HISTORY)


def valuation_history(valued: DataFrame) -> DataFrame:
    """Long rows of all multiples and the buyback flag (missing values are rows too)."""
    return unpivot_values(valued, list(HISTORY)).select("ticker", "end", "concept", "value")


def harmonic_rows(valued: DataFrame) -> DataFrame:
    """The multiples that are averaged, without periods next to an unexplained share jump."""
    sound = valued.filter(~F.coalesce(F.col("suspect") == 1.0, F.lit(False)))
    return unpivot_values(sound, list(HARMONIC_METRICS))


def drop_suspect_periods(series: DataFrame, flags: DataFrame) -> DataFrame:
    """Remove ``(ticker, end)`` rows that bracket an unexplained share jump."""
    flagged = flags.filter(F.col("share_count_jump_flag") == 1.0).select("ticker", "end")
    return series.join(flagged, ["ticker", "end"], "left_anti")


def five_year_averages(rows: DataFrame) -> DataFrame:
    """Rolling harmonic mean, median and count per company and multiple, long."""
    return rolling_harmonic_stats(rows, "value", "mean", K.FIVE_YEAR_DAYS, ("ticker", "concept"))


def five_year_averages_wide(averages: DataFrame) -> DataFrame:
    """One row per period with the published field names."""
    picks = []
    for metric, field in FIVE_YEAR_FIELDS.items():
        for source, suffix in (("mean", ""), ("mean_median", "_median"), ("mean_n", "_n")):
            picks.append(F.expr(
                f"max(CASE WHEN concept = '{metric}' THEN {source} END) AS {field}{suffix}"))
    return averages.groupBy("ticker", "end").agg(*picks)


def peer_band_flags(rows: DataFrame, profiles: DataFrame, as_of) -> DataFrame:
    """Whether a company's own five-year low lies above the median of its peers' latest value.

    ``rows`` are the sound harmonic rows.  A peer group is a profile; its median is exact and
    is found without gathering the group in one place.
    """
    window = five_year_window(rows, as_of).filter(F.col("value") > 0)
    own = window.groupBy("ticker", "concept").agg(
        F.min("value").alias("low"), F.max_by("value", "end").alias("latest"))
    own = with_profile(own, profiles)
    group = ["profile", "concept"]
    peers = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n_peers")).filter(
        F.col("n_peers") >= K.PEER_MIN_GROUP)
    peers = peers.join(group_median(own, group, "latest", "peer_median"), group)
    return own.join(peers, group).select(
        "ticker", F.concat("concept", F.lit("_band_elevated")).alias("concept"),
        (F.col("low") > F.col("peer_median")).cast("double").alias("value"))
