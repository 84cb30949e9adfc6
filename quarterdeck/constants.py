"""Numbers and names that define the published semantics."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Trailing twelve months: calendar bounds of the four-row window, in days.
TTM_SPAN_DAYS = (248, 333)
TTM_STEP_DAYS = (76, 137)

# Year-over-year growth.
GROWTH_TOLERANCE_DAYS_PER_YEAR = 45
GROWTH_MIN_BASE_RATIO = 0.33
GROWTH_LOOSE_BASE_RATIO = 0.05
GROWTH_LOOSE_BASE_CONCEPTS = (
    "Capex",
    "Goodwill",
    "CashAndEquivalents",
    "Inventory",
    "LongTermDebt",
    "ProvisionForCreditLosses",
    "TangibleEquity",
)
GROWTH_EXCLUDED_CONCEPTS = ("GainLossOnSaleOfProperties", "RealizedInvestmentGains")

# Scale guards.
METRIC_SCALE_RATIO = 0.01
VALUATION_SCALE_RATIO = 0.001
DEBT_EQUITY_SCALE_RATIO = 0.05
SELF_SCALE_RATIO = 0.10
SELF_SCALE_HALF_WINDOW_DAYS = 730

# Result limits.
OPERATING_LEVERAGE_MIN_GROWTH = 0.02
OPERATING_LEVERAGE_MAX_ABS = 15
NET_DEBT_EBITDA_MIN_EBITDA = 10_000_000
NET_DEBT_EBITDA_MAX_ABS = 60
PEG_MIN_GROWTH = 0.02
PEG_MAX_ABS = 30

# Latest value.
LATEST_VALUE_MAX_AGE_DAYS = 365

# Period lengths of filing facts, in days.
QUARTER_DAYS = (80, 100)
LONG_QUARTER_MAX_DAYS = 120
LONG_QUARTER_MIN_PERIODS = 3
ANNUAL_DAYS = (350, 380)
Q4_LOOKBACK_DAYS = 300
DUPLICATE_END_MAX_GAP_DAYS = 7
CANONICAL_END_MAX_GAP_DAYS = 7

# Quarter-over-quarter flags.
QOQ_GAP_DAYS = (60, 120)
BUYBACK_MIN_DECLINE = 0.15
GOODWILL_MIN_GROWTH = 0.20
SHARE_JUMP_MIN_CHANGE = 0.15
SHARE_JUMP_MIN_FLOW_RATIO = 0.5
PRICE_LOOKBACK_DAYS = 10
LOW_TAX_RATE = 0.10

# Five-year averages and peers.
FIVE_YEAR_DAYS = 1826
AVERAGE_DIVERGENCE = 0.20
AVERAGE_MIN_OBSERVATIONS = 12
PEER_MIN_GROUP = 5

# Share-count source.
SHARE_DISAGREEMENT = 0.10
SHARE_QUOTE_OVERSTATEMENT = 1.50
SHARE_FILING_MAX_LAG_DAYS = 200
SHARES_BASIS_CODES = {"diluted_wavg": 0.0, "period_end": 1.0}
PERIOD_END_SHARE_TAGS = (
    "CommonStockSharesOutstanding",
    "EntityCommonStockSharesOutstanding",
    "CommonStockSharesIssued",
)
WEIGHTED_SHARE_TAGS = (
    "WeightedAverageNumberOfDilutedSharesOutstanding",
    "WeightedAverageNumberOfSharesOutstandingBasic",
    "WeightedAverageNumberOfSharesOutstanding",
)

# Freshness.
STALE_AFTER_DAYS = 135
FILING_BUFFER_DAYS = 7
QUARTER_SPACING_DAYS = 91
FILING_LAG_LIMIT_DAYS = 200
PERIODIC_FORMS = ("10-Q", "10-K")

# Share-count repair.
SPLIT_MATCH_TOLERANCE = 0.02
SPLIT_MIN_LOG_MAGNITUDE = 0.182
SCALE_UP_FACTORS = (100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000)
SCALE_GATE_LOG = 1.5
SCALE_MATCH_LOG = 0.5
SCALE_EVIDENCE_LOG = 0.35
SIBLING_MIN_LOG = 0.7
SIBLING_POWER_TOLERANCE = 0.05
OUT_OF_LINE_LOG = 2.0
EPS_TAGS = ("EarningsPerShareDiluted", "EarningsPerShareBasic")

# Masks on extracted values.
NON_NEGATIVE_FLOWS = (
    "Revenue",
    "Capex",
    "CostOfRevenue",
    "DepreciationAndAmortization",
    "DividendsPerShare",
    "ResearchAndDevelopment",
    "EarnedPremiums",
)
NON_NEGATIVE_BALANCES = ("LongTermDebt",)

# Views.
OUTLIER_MEDIAN_RATIO = 5.0
OUTLIER_MIN_POINTS = 8
COMPARISON_MIN_TICKERS = 2
COVERAGE_THRESHOLD = 0.5
DUPLICATE_WARNING_ROWS = 6
MIN_IDENTIFIER_ENTRIES = 8000
PREFERRED_UNITS = ("USD", "USD/shares", "shares")
FLAGS_WITHOUT_SUFFIX = ("fcf_exceeds_ebitda", "inorganic_contaminated")

# Provenance labels.
TTM_ROLLING = "quarterly_rolling"
TTM_ANNUAL = "annual_fact"
FFO_GAINS_REPORTED = "reported"
FFO_GAINS_IMPUTED = "imputed_zero"
DEFAULT_PROFILE = "standard"
EXPORT_SCHEMA_VERSION = 2

TTM_CONCEPTS = (
    "Revenue",
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "OperatingCashFlow",
    "Capex",
    "DepreciationAndAmortization",
    "DividendsPerShare",
    "NetInterestIncome",
    "NoninterestExpense",
    "ProvisionForCreditLosses",
    "NoninterestIncome",
    "EarnedPremiums",
    "IncurredLosses",
    "BenefitsLossesAndExpenses",
    "NetInvestmentIncome",
    "RealizedInvestmentGains",
    "CostOfRevenue",
    "ResearchAndDevelopment",
    "RealEstateDepreciation",
    "GainLossOnSaleOfProperties",
    "ShareBasedCompensation",
    "IncomeTaxExpense",
    "PretaxIncome",
    "StockRepurchased",
    "StockIssued",
)
# --- end of fixed values ----------------------------------------------------
