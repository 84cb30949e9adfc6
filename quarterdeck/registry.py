"""Metric registry, profile rules and concept sources as small dimension frames.

Everything here is configuration whose size is fixed by this file (or by the parameters a
user passes in), never by the data, so the frames built from it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarterdeck import schemas
from quarterdeck.constants import DEFAULT_PROFILE

FUNDAMENTALS, VALUATION, GROWTH = "fundamentals", "valuation", "growth"

# Which published frame and column a chart reads.
CHART_COLUMNS = {FUNDAMENTALS: "value", VALUATION: "value", GROWTH: "yoy_growth"}


@dataclass(frozen=True)
class Metric:
    id: str
    chart: str
    label: str
    ref_line: float | None = None
    percent: bool = False
    quarterly: bool = False
    harmonic: bool = False
    description: str | None = None
    formula: str | None = None

    @property
    def value_column(self) -> str:
        return CHART_COLUMNS[self.chart]


def _m(metric_id, chart, label, ref=None, *, percent=False, twin=False, harmonic=False,
       formula=None, description=None) -> Metric:
    """``twin``: the metric has a quarterly counterpart."""
    return Metric(metric_id, chart, label, ref, percent, twin, harmonic, description, formula)


# --- fixed values: registered metrics in panel order ------------------------
METRICS: tuple[Metric, ...] = (
    _m("revenue_yoy_growth", FUNDAMENTALS, "Growth of revenue", 0, percent=True),
    _m("income_yoy_growth", FUNDAMENTALS, "Growth of net income", 0, percent=True),
    _m("operating_margin", FUNDAMENTALS, "Operating margin", percent=True, twin=True),
    _m("roe", FUNDAMENTALS, "Equity return", percent=True),
    _m("debt_to_equity", FUNDAMENTALS, "Debt over equity"),
    _m("payout_ratio", FUNDAMENTALS, "Share of income paid out", percent=True, twin=True),
    _m("fcf_margin", FUNDAMENTALS, "Free cash flow over revenue", percent=True, twin=True),
    _m("net_debt_to_ebitda", FUNDAMENTALS, "Net debt over EBITDA", 0),
    _m("rule_of_40", FUNDAMENTALS, "Growth plus margin", 0.4, percent=True),
    _m("net_interest_margin", FUNDAMENTALS, "Interest margin", percent=True),
    _m("efficiency_ratio", FUNDAMENTALS, "Cost over income", percent=True, twin=True),
    _m("roa", FUNDAMENTALS, "Asset return", percent=True),
    _m("equity_to_assets", FUNDAMENTALS, "Equity over assets", percent=True),
    _m("provision_ratio", FUNDAMENTALS, "Loan provisions over revenue", 0, percent=True, twin=True),
    _m("combined_ratio", FUNDAMENTALS, "Claims and costs over premiums", 1.0, percent=True, twin=True),
    _m("loss_ratio", FUNDAMENTALS, "Claims over premiums", percent=True, twin=True),
    _m("expense_ratio", FUNDAMENTALS, "Costs over premiums", percent=True, twin=True),
    _m("net_investment_yield", FUNDAMENTALS, "Yield of investments", percent=True),
    _m("reserve_growth", FUNDAMENTALS, "Growth of claims reserve", 0, percent=True),
    _m("inventory_turnover", FUNDAMENTALS, "Inventory turns a year"),
    _m("dio", FUNDAMENTALS, "Days in inventory"),
    _m("dso", FUNDAMENTALS, "Days until customers pay"),
    _m("dpo", FUNDAMENTALS, "Days until suppliers are paid"),
    _m("cash_conversion_cycle", FUNDAMENTALS, "Days of cash tied up", 0),
    _m("rd_intensity", FUNDAMENTALS, "Research over revenue", percent=True, twin=True),
    _m("capex_intensity", FUNDAMENTALS, "Capital spending over revenue", percent=True, twin=True),
    _m("operating_leverage", FUNDAMENTALS, "Income growth over revenue growth", 1.0),
    _m("operating_income_yoy_growth", FUNDAMENTALS, "Growth of operating income", 0, percent=True),
    _m("ffo_margin", FUNDAMENTALS, "Funds from operations over revenue", percent=True, twin=True),
    _m("pe_ratio", VALUATION, "Price over earnings", harmonic=True),
    _m("pb_ratio", VALUATION, "Price over book value"),
    _m("pfcf_ratio", VALUATION, "Price over free cash flow", harmonic=True),
    _m("ev_fcf", VALUATION, "Enterprise value over free cash flow"),
    _m("pfcf_ex_sbc", VALUATION, "Price over free cash flow less stock pay"),
    _m("ev_ebitda", VALUATION, "Enterprise value over EBITDA", harmonic=True),
    _m("ev_sales", VALUATION, "Enterprise value over sales"),
    _m("dividend_yield", VALUATION, "Dividend over price", percent=True),
    _m("p_tbv", VALUATION, "Price over tangible book value", harmonic=True),
    _m("p_ppnr", VALUATION, "Price over income before provisions", harmonic=True),
    _m("p_core_earnings", VALUATION, "Price over core earnings", harmonic=True),
    _m("p_ffo", VALUATION, "Price over funds from operations", harmonic=True),
    _m("pe_to_revenue_growth", VALUATION, "Earnings multiple over revenue growth"),
    _m("Revenue", GROWTH, "Quarterly revenue against a year ago", 0, percent=True),
    _m("NetIncomeLoss", GROWTH, "Quarterly net income against a year ago", 0, percent=True),
    _m("SharesOutstanding", GROWTH, "Share count against a year ago", 0, percent=True),
    _m("EPS_TTM_CALC", GROWTH, "Yearly earnings per share against a year ago", 0, percent=True),
    _m("FCF_TTM", GROWTH, "Yearly free cash flow against a year ago", 0, percent=True),
    _m("OperatingIncomeLoss_TTM", GROWTH, "Yearly operating income against a year ago", 0, percent=True),
    _m("StockholdersEquity", GROWTH, "Equity against a year ago", 0, percent=True),
    _m("PPNR", GROWTH, "Yearly income before provisions against a year ago", 0, percent=True),
    _m("CoreOperatingEarnings", GROWTH, "Yearly core earnings against a year ago", 0, percent=True),
    _m("FFO_TTM", GROWTH, "Yearly funds from operations against a year ago", 0, percent=True),
)

# Published name of the five-year average of each harmonic multiple.
FIVE_YEAR_FIELDS = {
    "pe_ratio": "avg_pe_5y",
    "pfcf_ratio": "avg_pfcf_5y",
    "ev_ebitda": "avg_ev_ebitda_5y",
    "p_tbv": "avg_p_tbv_5y",
    "p_ppnr": "avg_p_ppnr_5y",
    "p_core_earnings": "avg_p_core_earnings_5y",
    "p_ffo": "avg_p_ffo_5y",
}

# Derived name -> the registered metrics it feeds; hidden when all of them are hidden.
# The five fields of every five-year average are added by rule below.
_CONSUMERS = {
    "EPS_TTM_CALC": ("pe_ratio", "payout_ratio"),
    "TangibleEquity": ("p_tbv",),
    "PPNR": ("p_ppnr",),
    "CoreOperatingEarnings": ("p_core_earnings",),
    "FFO_TTM": ("p_ffo", "ffo_margin"),
    "FCF_TTM": ("pfcf_ratio", "fcf_margin", "ev_fcf", "pfcf_ex_sbc"),
    "ShareBasedCompensation": ("pfcf_ex_sbc",),
    "ShareBasedCompensation_TTM": ("pfcf_ex_sbc",),
    "owner_fcf": ("pfcf_ex_sbc",),
    "IncomeTaxExpense": ("effective_tax_rate",),
    "IncomeTaxExpense_TTM": ("effective_tax_rate",),
    "PretaxIncome": ("effective_tax_rate",),
    "PretaxIncome_TTM": ("effective_tax_rate",),
    "low_tax_rate_flag": ("effective_tax_rate",),
    "StockRepurchased": ("share_count_jump_flag",),
    "StockRepurchased_TTM": ("share_count_jump_flag",),
    "StockIssued": ("share_count_jump_flag",),
    "StockIssued_TTM": ("share_count_jump_flag",),
    "EBITDA_TTM": ("ev_ebitda", "net_debt_to_ebitda"),
    "eps_ttm": ("pe_ratio",),
    "pe_ttm": ("pe_ratio",),
    "pe_to_revenue_growth": ("pe_ratio",),
    "tangible_equity": ("p_tbv",),
    "ppnr_ttm": ("p_ppnr",),
    "core_earnings_ttm": ("p_core_earnings",),
    "fcf_ttm": ("pfcf_ratio", "fcf_margin"),
    "pfcf_ttm": ("pfcf_ratio",),
    "ebitda_ttm": ("ev_ebitda", "net_debt_to_ebitda"),
    "net_debt": ("net_debt_to_ebitda",),
    "ev": ("ev_ebitda", "ev_sales"),
    "EPS_QUARTERLY_CALC": ("pe_ratio", "payout_ratio"),
    "PPNR_QUARTERLY": ("p_ppnr",),
    "CoreOperatingEarnings_QUARTERLY": ("p_core_earnings",),
    "FFO_QUARTERLY": ("p_ffo", "ffo_margin"),
    "FCF_QUARTERLY": ("pfcf_ratio", "fcf_margin"),
    "EBITDA_QUARTERLY": ("ev_ebitda", "net_debt_to_ebitda"),
}

# Metric groups and, per profile, what is hidden.  A profile hides every sector group it
# does not own, plus the extras named for it.
_BANK = {"net_interest_margin", "efficiency_ratio", "roa", "equity_to_assets",
         "provision_ratio", "p_ppnr"}
_INSURER = {"combined_ratio", "loss_ratio", "expense_ratio", "net_investment_yield",
            "reserve_growth", "p_core_earnings"}
_BOOK = {"p_tbv"}
_WORKING_CAPITAL = {"inventory_turnover", "dio", "dso", "dpo", "cash_conversion_cycle"}
_RESEARCH = {"rd_intensity"}
_CAPEX = {"capex_intensity"}
_LEVERAGE = {"operating_leverage", "operating_income_yoy_growth"}
_PROPERTY = {"ffo_margin", "p_ffo"}
_SECTOR = (_BANK | _INSURER | _BOOK | _WORKING_CAPITAL | _RESEARCH | _CAPEX | _LEVERAGE
           | _PROPERTY)
_FORTY = {"rule_of_40"}
_OPERATING = {"operating_margin", "net_debt_to_ebitda", "ev_ebitda"}
_CASH_MULTIPLES = {"pfcf_ratio", "ev_fcf", "pfcf_ex_sbc"}
_FINANCIAL_EXTRA = (_FORTY | _OPERATING | _CASH_MULTIPLES
                    | {"pfcf_ttm", "ev_sales", "fcf_margin", "debt_to_equity", "pb_ratio"})

HIDDEN_BY_PROFILE: dict[str, set[str]] = {
    "standard": _SECTOR,
    "financial": (_SECTOR - _BANK - _BOOK) | _FINANCIAL_EXTRA | {"OperatingIncomeLoss_TTM"},
    "insurance_pc": (_SECTOR - _INSURER - _BOOK) | _FINANCIAL_EXTRA,
    "insurance_life": (_SECTOR - _INSURER - _BOOK) | _FINANCIAL_EXTRA,
    "retail": (_SECTOR - _WORKING_CAPITAL - _RESEARCH) | _FORTY
              | {"operating_margin", "net_debt_to_ebitda", "payout_ratio"},
    "consumer_staples": (_SECTOR - _WORKING_CAPITAL) | _FORTY,
    "pharma_medtech": _SECTOR | _FORTY | _OPERATING,
    "health_services": _SECTOR | _FORTY,
    "industrials": (_SECTOR - _CAPEX - _LEVERAGE) | _FORTY,
    "media": _SECTOR | _FORTY,
    "homebuilder": (_SECTOR - _WORKING_CAPITAL) | _FORTY | _OPERATING,
    "leisure": _SECTOR | _FORTY,
    "utilities": (_SECTOR - _CAPEX) | _FORTY | _CASH_MULTIPLES,
    "telecom_cable": (_SECTOR - _CAPEX) | _FORTY,
    "railroads": (_SECTOR - _CAPEX) | _FORTY,
    "energy": (_SECTOR - _CAPEX) | _FORTY,
    "energy_integrated": (_SECTOR - _CAPEX) | _FORTY | _OPERATING,
    "materials": (_SECTOR - _CAPEX) | _FORTY,
    "materials_integrated": (_SECTOR - _CAPEX) | _FORTY | _OPERATING,
    "reit": (_SECTOR - _PROPERTY) | _FORTY | _OPERATING
            | {"pe_ratio", "payout_ratio", "income_yoy_growth", "pfcf_ratio", "pfcf_ex_sbc",
               "fcf_margin"},
    "marketplace": (_SECTOR - _CAPEX) | {"dividend_yield", "payout_ratio"},
    "captive_finance": (_SECTOR - _CAPEX) | _FORTY,
    "airline": (_SECTOR - _CAPEX) | _FORTY,
    "alt_asset_manager": _SECTOR | _FORTY | _OPERATING | _CASH_MULTIPLES | {"fcf_margin"},
}

# Concepts a profile is known not to report; coverage does not ask for them.
EXCLUDED_BY_PROFILE: dict[str, tuple[str, ...]] = {
    "alt_asset_manager": ("OperatingIncomeLoss",),
    "standard": ("IncurredLosses", "ClaimsReserve", "NetInvestmentIncome", "EarnedPremiums",
                 "BenefitsLossesAndExpenses", "Investments", "RealizedInvestmentGains"),
    "financial": ("Capex", "OperatingIncomeLoss", "LongTermDebt", "CashAndEquivalents",
                  "RealizedInvestmentGains"),
    "insurance_pc": ("Capex", "CashAndEquivalents", "OperatingIncomeLoss"),
    "insurance_life": ("Capex", "CashAndEquivalents", "OperatingIncomeLoss",
                       "DepreciationAndAmortization"),
    "retail": ("Goodwill",),
    "pharma_medtech": ("OperatingIncomeLoss", "DepreciationAndAmortization"),
    "health_services": ("ResearchAndDevelopment",),
    "homebuilder": ("OperatingIncomeLoss",),
    "railroads": ("Goodwill",),
    "energy": ("Goodwill",),
    "energy_integrated": ("Goodwill", "OperatingIncomeLoss"),
    "materials_integrated": ("OperatingIncomeLoss",),
    "reit": ("OperatingIncomeLoss", "Capex"),
}

# Keywords to look for when a concept is thin or missing.
SEARCH_HINTS: dict[str, tuple[str, ...]] = {
    "Revenue": ("revenue", "salesrevenue"),
    "NetIncomeLoss": ("netincome",),
    "OperatingIncomeLoss": ("operatingincome",),
    "OperatingCashFlow": ("operatingactivities",),
    "Capex": ("propertyplant", "productiveassets"),
    "DepreciationAndAmortization": ("depreciation", "amortization"),
    "LongTermDebt": ("longtermdebt", "borrowings", "notespayable"),
    "CashAndEquivalents": ("cashandcash",),
    "StockholdersEquity": ("stockholdersequity",),
    "SharesOutstanding": ("sharesoutstanding",),
    "StockRepurchased": ("repurchase", "treasurystock", "buyback"),
    "StockIssued": ("issuanceofcommon", "stockissuedduringperiodvalue", "saleofequity"),
    "DividendsPerShare": ("dividendspershare",),
    "Assets": ("assets",),
    "NetInterestIncome": ("interestincome", "interestexpensenet"),
    "NoninterestExpense": ("noninterestexpense",),
    "NoninterestIncome": ("noninterestincome",),
    "Goodwill": ("goodwill", "intangible"),
    "ProvisionForCreditLosses": ("provisionforloan", "provisionforcredit"),
    "EarnedPremiums": ("premiumsearned",),
    "IncurredLosses": ("benefitsandclaims", "policyholderbenefits"),
    "BenefitsLossesAndExpenses": ("benefitslossesandexpenses",),
    "NetInvestmentIncome": ("netinvestmentincome",),
    "Investments": ("investments",),
    "ClaimsReserve": ("liabilityforclaims", "claimsadjustmentexpense", "futurepolicybenefits"),
    "RealizedInvestmentGains": ("realizedgain", "realizedinvestment"),
    "Inventory": ("inventorynet", "merchandiseinventory", "inventoryfinishedgoods"),
    "CostOfRevenue": ("costofgoods", "costofrevenue", "costofsales"),
    "AccountsReceivable": ("accountsreceivable", "receivablesnet"),
    "AccountsPayable": ("accountspayable",),
    "ResearchAndDevelopment": ("researchanddevelopment", "rndexpense"),
}
# --- end of fixed values ----------------------------------------------------

CONSUMERS: dict[str, tuple[str, ...]] = {
    **_CONSUMERS,
    **{f"{field}{suffix}": (metric,)
       for metric, field in FIVE_YEAR_FIELDS.items()
       for suffix in ("", "_median", "_diverges", "_n", "_history_too_short")},
}
HARMONIC_METRICS = tuple(m.id for m in METRICS if m.harmonic)
QUARTERLY_TWINS = {m.id: f"{m.id}_quarterly" for m in METRICS if m.quarterly}
GROWTH_PANELS = tuple(m.id for m in METRICS if m.chart == GROWTH)


def check_registry(metrics: Iterable[Metric]) -> None:
    """Refuse an unknown chart or an id registered twice."""
    seen: dict[str, str] = {}
    for metric in metrics:
        if metric.chart not in CHART_COLUMNS:
            raise ValueError(f"{metric.id}: unknown chart {metric.chart!r}")
        if metric.id in seen:
            raise ValueError(f"{metric.id}: registered for {seen[metric.id]} and {metric.chart}")
        seen[metric.id] = metric.chart


check_registry(METRICS)


def hidden_names(hidden: Iterable[str]) -> set[str]:
    """All concept names a profile suppresses, given the metrics it hides.

    Closed under the two derivation rules (quarterly twin, all consumers hidden), so the
    visibility filter is a plain anti-join against this set.
    """
    hidden = set(hidden)
    fed_only_hidden = {name for name, users in CONSUMERS.items() if hidden.issuperset(users)}
    names = hidden | fed_only_hidden
    twins = {f"{name}_quarterly" for name in names}
    # a twin that has consumers of its own is judged by those, not by its base name
    return names | {t for t in twins if t not in CONSUMERS or t in fed_only_hidden
                    or t[: -len("_quarterly")] in hidden}


def registry_frame(spark: SparkSession, metrics: Iterable[Metric] = METRICS) -> DataFrame:
    rows = [
        (i, m.id, m.chart, m.label, None if m.ref_line is None else float(m.ref_line),
         m.percent, m.quarterly, m.harmonic, m.value_column, QUARTERLY_TWINS.get(m.id),
         bool(m.description and m.formula))
        for i, m in enumerate(metrics)
    ]
    return spark.createDataFrame(
        rows,
        "position int, id string, chart string, label string, ref_line double, "
        "percent boolean, quarterly boolean, harmonic boolean, value_column string, "
        "quarterly_id string, documented boolean",
    )


def hidden_frame(
    spark: SparkSession, hidden_by_profile: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    table = HIDDEN_BY_PROFILE if hidden_by_profile is None else hidden_by_profile
    rows = [(p, name) for p, hidden in table.items() for name in sorted(hidden_names(hidden))]
    return spark.createDataFrame(rows, "profile string, concept string")


def excluded_frame(
    spark: SparkSession, excluded: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    table = EXCLUDED_BY_PROFILE if excluded is None else excluded
    rows = [(p, c) for p, concepts in table.items() for c in concepts]
    return spark.createDataFrame(rows, "profile string, concept string")


def hints_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(concept, " ".join(words)) for concept, words in SEARCH_HINTS.items()],
        "concept string, hint string",
    )


def profiles_frame(spark: SparkSession, profiles: Mapping[str, str]) -> DataFrame:
    """The caller's ticker -> profile mapping as a frame (it is a parameter, not built in)."""
    return spark.createDataFrame(sorted(profiles.items()), schemas.PROFILES)


def profile_names(hidden_by_profile: Mapping[str, Iterable[str]] | None = None) -> list[str]:
    table = HIDDEN_BY_PROFILE if hidden_by_profile is None else hidden_by_profile
    return sorted(set(table) | {DEFAULT_PROFILE})
