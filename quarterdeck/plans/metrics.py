"""Ratios, growth rates and quality flags on the wide frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import Cell
from quarterdeck.functions.expr import (
    by_ticker, filled_reference, flag, is_true, positive, too_small,
)
from quarterdeck.operators.reshape import unpivot_states
from quarterdeck.plans.derived import with_derived
from quarterdeck.plans.wide import MARKET_PRICE, build_wide

FLAGS = ("buyback_distortion_flag", "inorganic_contaminated", "share_count_jump_flag",
         "fcf_exceeds_ebitda", "low_tax_rate_flag")
METRICS = (
    "effective_tax_rate", "revenue_yoy_growth", "income_yoy_growth", "operating_margin", "roe",
    "rotce", "debt_to_equity", "payout_ratio", "fcf_margin", "net_debt_to_ebitda", "rule_of_40",
    "net_interest_margin", "efficiency_ratio", "roa", "equity_to_assets", "provision_ratio",
    "combined_ratio", "loss_ratio", "expense_ratio", "net_investment_yield", "reserve_growth",
    "inventory_turnover", "dio", "dso", "dpo", "cash_conversion_cycle", "rd_intensity",
    "capex_intensity", "operating_leverage", "operating_income_yoy_growth", "ffo_margin",
)
QUARTERLY_METRICS = (
    "operating_margin_quarterly", "payout_ratio_quarterly", "fcf_margin_quarterly",
    "efficiency_ratio_quarterly", "provision_ratio_quarterly", "combined_ratio_quarterly",
    "loss_ratio_quarterly", "expense_ratio_quarterly", "rd_intensity_quarterly",
    "capex_intensity_quarterly", "ffo_margin_quarterly",
)
INTERMEDIATE = ("net_debt", "owner_fcf")
PUBLISHED = (*FLAGS, *METRICS, *QUARTERLY_METRICS)

# ratios that need nothing but a division: name -> (numerator, denominator)
_PLAIN = {
    "net_interest_margin": ("NetInterestIncome_TTM", "Assets"),
    "efficiency_ratio": ("NoninterestExpense_TTM", "Revenue_TTM"),
    "roa": ("NetIncomeLoss_TTM", "Assets"),
    "equity_to_assets": ("StockholdersEquity", "Assets"),
    "provision_ratio": ("ProvisionForCreditLosses_TTM", "Revenue_TTM"),
    "combined_ratio": ("BenefitsLossesAndExpenses_TTM", "EarnedPremiums_TTM"),
    "loss_ratio": ("IncurredLosses_TTM", "EarnedPremiums_TTM"),
    "net_investment_yield": ("NetInvestmentIncome_TTM", "Investments"),
    "inventory_turnover": ("CostOfRevenue_TTM", "Inventory"),
    "rd_intensity": ("ResearchAndDevelopment_TTM", "Revenue_TTM"),
    "capex_intensity": ("Capex_TTM", "Revenue_TTM"),
    "ffo_margin": ("FFO_TTM", "Revenue_TTM"),
    "operating_margin_quarterly": ("OperatingIncomeLoss", "Revenue"),
    "fcf_margin_quarterly": ("FCF_QUARTERLY", "Revenue"),
    "efficiency_ratio_quarterly": ("NoninterestExpense", "Revenue"),
    "provision_ratio_quarterly": ("ProvisionForCreditLosses", "Revenue"),
    "combined_ratio_quarterly": ("BenefitsLossesAndExpenses", "EarnedPremiums"),
    "loss_ratio_quarterly": ("IncurredLosses", "EarnedPremiums"),
    "rd_intensity_quarterly": ("ResearchAndDevelopment", "Revenue"),
    "capex_intensity_quarterly": ("Capex", "Revenue"),
    "ffo_margin_quarterly": ("FFO_QUARTERLY", "Revenue"),
}
# stocks expressed in days of a yearly flow
_DAYS = {
    "dio": ("Inventory", "CostOfRevenue_TTM"),
    "dso": ("AccountsReceivable", "Revenue_TTM"),
    "dpo": ("AccountsPayable", "CostOfRevenue_TTM"),
}
# positive denominator that must also be large against a reference
_GUARDED = {
    "effective_tax_rate": ("IncomeTaxExpense_TTM", "PretaxIncome_TTM", "Revenue_TTM",
                           K.METRIC_SCALE_RATIO),
    "roe": ("NetIncomeLoss_TTM", "StockholdersEquity", "Revenue_TTM", K.METRIC_SCALE_RATIO),
    "rotce": ("NetIncomeLoss_TTM", "TangibleEquity", "Revenue_TTM", K.METRIC_SCALE_RATIO),
    "debt_to_equity": ("LongTermDebt", "StockholdersEquity", "LongTermDebt",
                       K.DEBT_EQUITY_SCALE_RATIO),
}


def _plain_metrics() -> dict[str, Cell]:
    c = Cell.of
    out = {name: c(a) / c(b) for name, (a, b) in _PLAIN.items()}
    out |= {name: (c(a) / c(b)).times(365) for name, (a, b) in _DAYS.items()}
    out["expense_ratio"] = out["combined_ratio"] - out["loss_ratio"]
    out["expense_ratio_quarterly"] = (out["combined_ratio_quarterly"]
                                      - out["loss_ratio_quarterly"])
    out["cash_conversion_cycle"] = out["dio"] + out["dso"] - out["dpo"]
    out["payout_ratio"] = c("DividendsPerShare_TTM") / c("EPS_TTM_CALC").if_positive()
    out["payout_ratio_quarterly"] = (c("DividendsPerShare")
                                     / c("EPS_QUARTERLY_CALC").if_positive())
    out["net_debt"] = c("LongTermDebt") - c("CashAndEquivalents")
    out["owner_fcf"] = c("FCF_TTM") - c("ShareBasedCompensation_TTM")
    return out


def _growth_metrics() -> dict[str, Cell]:
    revenue = Cell(F.col("g_revenue"), Cell.of("Revenue_TTM").exists)
    operating = Cell(F.col("g_operating_income"), Cell.of("OperatingIncomeLoss_TTM").exists)
    leverage = (operating / revenue).blank(
        F.abs(revenue.value) < K.OPERATING_LEVERAGE_MIN_GROWTH)
    return {
        "revenue_yoy_growth": revenue,
        "income_yoy_growth": Cell(F.col("g_income"), Cell.of("NetIncomeLoss_TTM").exists),
        "operating_income_yoy_growth": operating,
        "reserve_growth": Cell(F.col("g_reserve"), Cell.of("ClaimsReserve").exists),
        "operating_leverage": leverage.blank(
            F.abs(leverage.value) > K.OPERATING_LEVERAGE_MAX_ABS),
    }


def _scale_guarded(window) -> dict[str, Cell]:
    out = {}
    for name, (above, below, reference, share) in _GUARDED.items():
        denominator = Cell.of(below).if_positive()
        ratio = Cell.of(above) / denominator
        # only the periods of this ratio lend each other a reference
        scale = filled_reference(F.when(ratio.exists, Cell.of(reference).value), window)
        out[name] = ratio.blank(too_small(denominator.value, scale, share))
    return out


def _self_guarded(name: str, above: str, window) -> Cell:
    ratio = Cell.of(above) / Cell.of("Revenue_TTM")
    size = F.abs(Cell.of("Revenue_TTM").value)
    around = window.rangeBetween(-K.SELF_SCALE_HALF_WINDOW_DAYS, K.SELF_SCALE_HALF_WINDOW_DAYS)
    largest = F.max(F.when(ratio.exists, size)).over(around)
    return ratio.blank(size < F.lit(K.SELF_SCALE_RATIO) * largest)


def _net_debt_to_ebitda() -> Cell:
    ebitda = Cell.of("EBITDA_TTM")
    ratio = (Cell.of("net_debt") / ebitda).blank(
        F.abs(ebitda.value) < K.NET_DEBT_EBITDA_MIN_EBITDA)
    return ratio.blank(F.abs(ratio.value) > K.NET_DEBT_EBITDA_MAX_ABS)


# --- flags ------------------------------------------------------------------

def _gap_ok(previous_day: str) -> Column:
    return (F.col("day") - F.col(previous_day)).between(*K.QOQ_GAP_DAYS)


def buyback_distortion() -> Column:
    """Equity fell sharply in one quarter although the company earns money."""
    equity, before = Cell.of("StockholdersEquity").value, F.col("prev_equity")
    applicable = _gap_ok("prev_equity_day") & (equity > 0) & (before > 0)
    fell = 1 - F.try_divide(equity, before) > K.BUYBACK_MIN_DECLINE
    return flag(fell & (Cell.of("NetIncomeLoss_TTM").value > 0), applicable)


def inorganic_growth() -> Column:
    goodwill, before = Cell.of("Goodwill").value, F.col("prev_goodwill")
    applicable = _gap_ok("prev_goodwill_day") & (before > 0)
    grown = F.try_divide(goodwill, before) - 1 > K.GOODWILL_MIN_GROWTH
    return flag(grown, applicable)


def share_jump_here() -> Column:
    """Share count moved by more than the period's repurchases and issues explain."""
    shares, before = Cell.of("SharesOutstanding").value, F.col("prev_shares")
    applicable = _gap_ok("prev_shares_day") & (before > 0)
    moved = F.abs(F.try_divide(shares, before) - 1) > K.SHARE_JUMP_MIN_CHANGE
    cash = F.greatest(F.abs(Cell.of("StockRepurchased").value),
                      F.abs(Cell.of("StockIssued").value))
    explained = (F.try_divide(cash, positive(F.col(MARKET_PRICE)))
                 >= F.lit(K.SHARE_JUMP_MIN_FLOW_RATIO) * F.abs(shares - before))
    return flag(is_true(moved) & ~is_true(explained), applicable)


def share_jump_both_sides(here: str) -> Column:
    """A jump lies between two quarters: the earlier one is flagged as well.

    Read from the newest row backwards, the first row with a share count above this one is
    the next quarter of the series.
    """
    back = Window.partitionBy("ticker").orderBy(F.col("day").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    following = F.when(Cell.of("SharesOutstanding").exists,
                       F.coalesce(F.col(here), F.lit(-1.0)))
    next_jumps = F.last(following, ignorenulls=True).over(back) == 1.0
    is_row = Cell.of("SharesOutstanding").exists
    return F.when(is_row & is_true(next_jumps), F.lit(1.0)).otherwise(F.col(here))


def fcf_exceeds_ebitda() -> Column:
    fcf, ebitda = Cell.of("FCF_TTM").value, Cell.of("EBITDA_TTM").value
    return flag(fcf > ebitda, (fcf > 0) & (ebitda > 0))


def with_metrics(wide: DataFrame) -> DataFrame:
    """All metrics and flags as further encoded columns of a wide frame with derived concepts."""
    window = by_ticker()
    first = {**_plain_metrics(), **_growth_metrics(), **_scale_guarded(window),
             "operating_margin": _self_guarded("operating_margin", "OperatingIncomeLoss_TTM",
                                               window),
             "fcf_margin": _self_guarded("fcf_margin", "FCF_TTM", window),
             "buyback_distortion_flag": Cell.where_known(buyback_distortion()),
             "inorganic_contaminated": Cell.where_known(inorganic_growth()),
             "fcf_exceeds_ebitda": Cell.where_known(fcf_exceeds_ebitda())}
    out = wide.withColumns({
        **{name: cell.encoded() for name, cell in first.items()},
        "_jump": share_jump_here(),
    })
    rate = Cell.of("effective_tax_rate").value
    second = {
        "net_debt_to_ebitda": _net_debt_to_ebitda(),
        "rule_of_40": Cell.of("revenue_yoy_growth") + Cell.of("fcf_margin"),
        "low_tax_rate_flag": Cell.where_known(flag(rate < K.LOW_TAX_RATE, rate.isNotNull())),
        "share_count_jump_flag": Cell.where_known(share_jump_both_sides("_jump")),
    }
    return out.withColumns({n: c.encoded() for n, c in second.items()}).drop("_jump")


def metrics_wide(facts: DataFrame, price_history: DataFrame | None = None) -> DataFrame:
    return with_metrics(with_derived(build_wide(facts, price_history)))


def metrics_long(wide: DataFrame) -> DataFrame:
    """The published metrics as long rows (a row may carry a missing value)."""
    return unpivot_states(wide, list(PUBLISHED)).select("ticker", "end", "concept", "value")


def flag_rows(wide: DataFrame, name: str) -> DataFrame:
    state = Cell.of(name)
    return wide.filter(state.exists).select("ticker", "end", state.value.alias(name))
