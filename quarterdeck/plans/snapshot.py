"""The current (or as-of) picture: one set of rows per company."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import Cell
from quarterdeck.functions.expr import blank_where, positive
from quarterdeck.operators.reshape import unpivot_values
from quarterdeck.operators.timeseries import price_as_of
from quarterdeck.plans.valuation import over_positive, price_to_growth, scale_guarded
from quarterdeck.registry import FIVE_YEAR_FIELDS

# concept -> published field; the newest known value, at most a year behind the newest row
LATEST_VALUES = {
    "EPS_TTM_CALC": "eps_ttm",
    "StockholdersEquity": "equity",
    "Revenue_TTM": "revenue_ttm",
    "DividendsPerShare_TTM": "dividends_ttm",
    "LongTermDebt": "debt",
    "CashAndEquivalents": "cash",
    "TangibleEquity": "tangible_equity",
    "PPNR": "ppnr_ttm",
    "CoreOperatingEarnings": "core_earnings_ttm",
    "FFO_TTM": "ffo_ttm",
    "ShareBasedCompensation_TTM": "sbc_ttm",
    "SharesOutstanding": "_filed_shares",
}
NOT_PUBLISHED = ("ffo_ttm", "sbc_ttm", "_filed_shares")
# metric -> published field; the newest row, whether or not it carries a value
LATEST_ROWS = {
    "FCF_TTM": "fcf_ttm",
    "EBITDA_TTM": "ebitda_ttm",
    "revenue_yoy_growth": "yoy_growth",
    **{m: m for m in (
        "net_interest_margin", "efficiency_ratio", "roa", "equity_to_assets", "provision_ratio",
        "combined_ratio", "loss_ratio", "expense_ratio", "net_investment_yield",
        "reserve_growth", "inventory_turnover", "dio", "dso", "dpo", "cash_conversion_cycle",
        "rd_intensity", "capex_intensity", "operating_leverage")},
}


def latest_per_company(wide: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Everything the snapshot needs from the wide frame in one aggregation per company."""
    picks: list[Column] = [F.max("end").alias("newest_end")]
    for concept, field in LATEST_VALUES.items():
        known = f"CASE WHEN `{concept}` > double('-infinity') THEN day END"
        picks += [
            F.expr(f"max({known}) AS `{field}_day`"),
            F.expr(f"max_by(`{concept}`, {known}) AS `{field}`"),
            F.expr(f"max(CASE WHEN `{concept}` IS NOT NULL THEN day END) AS `{field}_row_day`"),
        ]
    for concept, field in LATEST_ROWS.items():
        picks.append(F.expr(
            f"max_by(`{concept}`, CASE WHEN `{concept}` IS NOT NULL THEN day END) AS `{field}`"))
    found = wide.groupBy(*keys).agg(*picks)
    ages = {f"{f}_age_days": F.col(f"{f}_row_day") - F.col(f"{f}_day")
            for f in LATEST_VALUES.values()}
    found = found.withColumns({
        **ages,
        **{f: Cell.of(f).value for f in LATEST_ROWS.values()},
        "_revenue_scale": F.col("revenue_ttm"),
    })
    recent = {f: F.when(F.col(f"{f}_age_days") <= K.LATEST_VALUE_MAX_AGE_DAYS, F.col(f))
              for f in LATEST_VALUES.values()}
    return found.withColumns(recent).withColumns({
        f"{f}_age_days": F.when(F.col(f).isNotNull() & (F.col(f"{f}_age_days") > 0),
                                F.col(f"{f}_age_days")) for f in LATEST_VALUES.values()
    }).withColumn("_lag", F.datediff("newest_end", F.date_from_unix_date("_filed_shares_day")))


def latest_averages(averages: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Newest five-year averages per company with their two reliability flags."""
    known = averages.filter(F.col("mean").isNotNull())
    picks = []
    for metric, field in FIVE_YEAR_FIELDS.items():
        at = f"CASE WHEN concept = '{metric}' THEN end END"
        picks += [F.expr(f"max_by(mean, {at}) AS {field}"),
                  F.expr(f"max_by(mean_median, {at}) AS {field}_median"),
                  F.expr(f"max_by(mean_n, {at}) AS {field}_n")]
    out = known.groupBy(*keys).agg(*picks)
    extra = {}
    for field in FIVE_YEAR_FIELDS.values():
        apart = F.try_divide(F.abs(F.col(field) - F.col(f"{field}_median")),
                             F.col(f"{field}_median"))
        has = F.col(field).isNotNull()
        extra[f"{field}_diverges"] = F.when(
            has, F.coalesce(apart > K.AVERAGE_DIVERGENCE, F.lit(False)).cast("double"))
        extra[f"{field}_history_too_short"] = F.when(
            has, (F.col(f"{field}_n") < K.AVERAGE_MIN_OBSERVATIONS).cast("double"))
    return out.withColumns(extra).drop(*[f"{f}_n" for f in FIVE_YEAR_FIELDS.values()])


def with_share_source(snap: DataFrame) -> DataFrame:
    """Choose between the filed and the quoted share count."""
    filed, quoted = F.col("_filed_shares"), F.col("shares_outstanding")
    usable = (quoted > 0) & (filed > 0)
    filed_larger = F.try_divide(filed, quoted) > 1 + K.SHARE_DISAGREEMENT
    quote_inflated = F.try_divide(quoted, filed) > K.SHARE_QUOTE_OVERSTATEMENT
    current = F.col("_lag") <= K.SHARE_FILING_MAX_LAG_DAYS
    prefer = F.coalesce(usable & (F.coalesce(filed_larger, F.lit(False))
                                  | F.coalesce(quote_inflated & current, F.lit(False))),
                        F.lit(False))
    return snap.withColumns({
        "shares_source_is_edgar": prefer.cast("double"),
        "shares_delta_pct": F.try_divide(filed - quoted, quoted) * 100,
        "shares_outstanding": F.when(prefer, filed).otherwise(quoted),
    }).withColumn("market_cap", F.col("price") * F.col("shares_outstanding"))


def with_current_multiples(snap: DataFrame) -> DataFrame:
    """The multiples at today's price.

    They follow the history's rules, except that a few carry no scale guard and EV/sales,
    P/PPNR and P/core earnings no positivity mask.
    """
    base = snap.withColumns({
        "net_debt": F.expr("debt - cash"),
        "_owner_fcf": F.expr("fcf_ttm - sbc_ttm"),
        "pe_ratio": over_positive(F.col("price"), F.col("eps_ttm")),
    }).withColumn("ev", F.expr("market_cap + net_debt"))
    cap, ev, scale = F.col("market_cap"), F.col("ev"), F.col("_revenue_scale")

    def guarded(above: Column, below: str) -> Column:
        return scale_guarded(over_positive(above, F.col(below)), F.col(below), scale)

    return base.withColumns({
        "pb_ratio": blank_where(guarded(cap, "equity"), F.col("tangible_equity") < 0),
        "pfcf_ratio": over_positive(cap, F.col("fcf_ttm")),
        "ev_ebitda": over_positive(ev, F.col("ebitda_ttm")),
        "ev_sales": F.try_divide(ev, F.col("revenue_ttm")),
        "pe_to_revenue_growth": price_to_growth(positive(F.col("pe_ratio")), F.col("yoy_growth")),
        "dividend_yield": F.try_divide(F.col("dividends_ttm"), F.col("price")),
        "p_tbv": guarded(cap, "tangible_equity"),
        "p_ppnr": F.try_divide(cap, F.col("ppnr_ttm")),
        "p_core_earnings": F.try_divide(cap, F.col("core_earnings_ttm")),
        "p_ffo": guarded(cap, "ffo_ttm"),
        "ev_fcf": guarded(ev, "fcf_ttm"),
        "pfcf_ex_sbc": guarded(cap, "_owner_fcf"),
    })


CURRENT_MULTIPLES = ("net_debt", "ev", "pe_ratio", "pb_ratio", "pfcf_ratio", "ev_ebitda",
                     "ev_sales", "pe_to_revenue_growth", "dividend_yield", "p_tbv", "p_ppnr",
                     "p_core_earnings", "p_ffo", "ev_fcf", "pfcf_ex_sbc")


def published_fields() -> list[str]:
    latest = [f for f in LATEST_VALUES.values() if f not in NOT_PUBLISHED]
    aged = [f for f in LATEST_VALUES.values() if f != "_filed_shares"]
    averages = [f"{f}{s}" for f in FIVE_YEAR_FIELDS.values()
                for s in ("", "_median", "_diverges", "_history_too_short")]
    return ["price", "shares_outstanding", "market_cap", "shares_source_is_edgar",
            "shares_delta_pct", *latest, *LATEST_ROWS.values(), *averages, *CURRENT_MULTIPLES,
            *[f"{f}_age_days" for f in aged]]


def build_snapshot(wide: DataFrame, quotes: DataFrame, averages: DataFrame, as_of,
                   peer_flags: DataFrame | None = None,
                   shares_basis: DataFrame | None = None) -> DataFrame:
    """Long snapshot rows ``(ticker, end = as_of, concept, value)``; missing values have no row.

    ``wide`` carries derived concepts and metrics; ``averages`` is the long five-year frame.
    """
    snap = (quotes.select("ticker", "price", "shares_outstanding")
            .join(latest_per_company(wide), "ticker", "left")
            .join(latest_averages(averages), "ticker", "left"))
    fields = published_fields()
    if shares_basis is not None:
        snap = snap.join(shares_basis.select("ticker", "shares_basis"), "ticker", "left")
        fields = [*fields, "shares_basis"]
    snap = with_current_multiples(with_share_source(snap))
    long = unpivot_values(snap, fields, ("ticker",), keep_null=False)
    if peer_flags is not None:
        long = long.unionByName(peer_flags.select("ticker", "concept", "value"))
    return long.select("ticker", F.lit(as_of).cast("date").alias("end"), "concept", "value")


def build_snapshot_as_of(cutoff, wide: DataFrame, price_history: DataFrame,
                         averages: DataFrame) -> DataFrame:
    """The snapshot as rows up to ``cutoff`` would give it.

    Only rows are cut: the centred scale guard behind the metrics has already looked at
    later periods.
    """
    limit = F.lit(cutoff).cast("date")
    known = wide.filter(F.col("end") <= limit)
    shares = latest_per_company(known).select(
        "ticker", F.col("_filed_shares").alias("shares_outstanding"))
    quotes = price_as_of(price_history, cutoff).join(shares, "ticker", "left")
    return build_snapshot(known, quotes, averages.filter(F.col("end") <= limit), cutoff)


def build_snapshots_as_of(cutoffs: Sequence[str], wide: DataFrame, price_history: DataFrame,
                          averages: DataFrame) -> DataFrame:
    """The snapshots of a list of dates in one pass, as ``build_snapshot_as_of`` gives them.

    A row goes to every date that it precedes, and one aggregation per company and date
    combines it map-side: the plan has one size for any number of dates.
    """
    keys = ("ticker", "cutoff")
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])

    def known(rows: DataFrame, day: str) -> DataFrame:
        return rows.withColumn("cutoff", F.explode(F.filter(dates, lambda c: c >= F.col(day))))

    quotes = known(price_history, "date").groupBy(*keys).agg(F.max_by("close", "date").alias("price"))
    latest = latest_per_company(known(wide, "end"), keys)
    snap = quotes.join(latest, list(keys), "left").withColumn("shares_outstanding", F.col("_filed_shares")).join(
        latest_averages(known(averages, "end"), keys), list(keys), "left")
    snap = with_current_multiples(with_share_source(snap))
    long = unpivot_values(snap, published_fields(), keys, keep_null=False)
    return long.select("ticker", F.col("cutoff").alias("end"), "concept", "value")
