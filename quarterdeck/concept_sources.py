"""Which filing tags feed a concept, in which order.

A candidate is a list of prioritised *sources*.  A source is one tag or a sum of tags; the
first source that has a value for a period end wins.  Layers replace each other per concept:
company over profile over base.  Profile and company layers may also be passed in by the
caller as plain mappings or read from JSON (``load_layer``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from quarterdeck import schemas


@dataclass(frozen=True)
class Source:
    tags: tuple[str, ...]
    kind: str = "tag"                 # 'tag' or 'sum'
    require: str | None = None        # a sum counts only where this tag has a value
    only_if_empty: bool = False       # use only when no other source yields anything


@dataclass(frozen=True)
class Candidate:
    sources: tuple[Source, ...] = field(default_factory=tuple)
    point_in_time: bool = False
    non_negative: bool = False

    def plus(self, *tags: str) -> "Candidate":
        return replace(self, sources=self.sources + tuple(Source((t,)) for t in tags))


def flow(*tags: str) -> Candidate:
    return Candidate(tuple(Source((t,)) for t in tags))


def balance(*tags: str) -> Candidate:
    return Candidate(tuple(Source((t,)) for t in tags), point_in_time=True)


def total(*tags: str, require: str | None = None) -> Source:
    return Source(tags, "sum", require)


def ranked(*sources: str | Source, point_in_time=False, non_negative=False) -> Candidate:
    parsed = tuple(s if isinstance(s, Source) else Source((s,)) for s in sources)
    return Candidate(parsed, point_in_time, non_negative)


# --- fixed values: tags per concept, in priority order ----------------------
BASE: dict[str, Candidate] = {
    "Revenue": flow(
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
    ),
    "NetIncomeLoss": flow("NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"),
    "SharesOutstanding": balance(
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfSharesOutstandingBasic",
        "CommonStockSharesOutstanding",
    ),
    "StockholdersEquity": balance(
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "OperatingIncomeLoss": flow("OperatingIncomeLoss"),
    "OperatingCashFlow": flow(
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
        "NetCashProvidedByUsedInOperatingActivities",
    ),
    "Capex": flow(
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsToAcquireProductiveAssets",
    ),
    "DepreciationAndAmortization": ranked(
        "DepreciationDepletionAndAmortization",
        "DepreciationAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        total("Depreciation", "AmortizationOfIntangibleAssets"),
        "AdjustmentForAmortization",
        "FiniteLivedIntangibleAssetsAmortizationExpense",
    ),
    "LongTermDebt": ranked(
        "LongTermDebt",
        "DebtLongtermAndShorttermCombinedAmount",
        "LongTermNotesAndLoans",
        "ConvertibleLongTermNotesPayable",
        "ConvertibleDebtNoncurrent",
        total("LongTermDebtNoncurrent", "LongTermDebtCurrent", "NotesPayableCurrent",
              require="LongTermDebtNoncurrent"),
        "LongTermDebtAndCapitalLeaseObligations",
        "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities",
        "UnsecuredLongTermDebt",
        "ConvertibleDebtCurrent",
        "ConvertibleNotesPayableCurrent",
        point_in_time=True,
        non_negative=True,
    ),
    "CashAndEquivalents": balance(
        "CashAndCashEquivalentsAtCarryingValue",
        "CashAndCashEquivalentsAtCarryingValueIncludingDiscontinuedOperations",
    ),
    "DividendsPerShare": flow(
        "CommonStockDividendsPerShareDeclared",
        "CommonStockDividendsPerShareCashPaid",
    ),
    "Goodwill": balance("Goodwill"),
    "ShareBasedCompensation": flow(
        "ShareBasedCompensation",
        "AllocatedShareBasedCompensationExpense",
        "AdjustmentsToAdditionalPaidInCapitalSharebasedCompensationRequisiteServicePeriodRecognitionValue",
    ),
    "IncomeTaxExpense": flow("IncomeTaxExpenseBenefit"),
    "PretaxIncome": flow(
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
    ),
    "StockRepurchased": flow(
        "PaymentsForRepurchaseOfCommonStock",
        "PaymentsForRepurchaseOfEquity",
        "StockRepurchasedDuringPeriodValue",
        "StockRepurchasedAndRetiredDuringPeriodValue",
        "TreasuryStockValueAcquiredCostMethod",
        "PartnersCapitalAccountTreasuryUnitsPurchases",
    ),
    "StockIssued": flow(
        "ProceedsFromIssuanceOfCommonStock",
        "StockIssuedDuringPeriodValueNewIssues",
        "ProceedsFromIssuanceOrSaleOfEquity",
        "ProceedsFromIssuanceOfSharesUnderIncentiveAndShareBasedCompensationPlansIncludingStockOptions",
        "ProceedsFromStockPlans",
        "ProceedsFromStockOptionsExercised",
        "ProceedsFromIssuanceOfSharesUnderIncentiveAndShareBasedCompensationPlans",
        "ProceedsFromSaleOfTreasuryStock",
        "StockIssuedDuringPeriodValueStockOptionsExercised",
        "StockIssuedDuringPeriodValueEmployeeStockPurchasePlan",
    ),
}

_LONG_DEBT = (
    "LongTermDebt",
    "DebtLongtermAndShorttermCombinedAmount",
    "LongTermNotesAndLoans",
    "ConvertibleLongTermNotesPayable",
    "ConvertibleDebtNoncurrent",
    "ConvertibleDebtCurrent",
    "ConvertibleNotesPayableCurrent",
    total("LongTermDebtNoncurrent", "LongTermDebtCurrent", "NotesPayableCurrent"),
    "LongTermDebtAndCapitalLeaseObligations",
    "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities",
    "UnsecuredLongTermDebt",
)
_RESTRICTED_CASH = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"
_OTHER_PLANT = "PaymentsToAcquireOtherPropertyPlantAndEquipment"
_CASH, _CAPEX_BASE, _REVENUE = BASE["CashAndEquivalents"], BASE["Capex"], BASE["Revenue"]
_HEALTH = {
    "ResearchAndDevelopment": flow(
        "ResearchAndDevelopmentExpense",
        "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost",
    ),
    "Capex": _CAPEX_BASE.plus(_OTHER_PLANT),
}
_OIL = {
    "Capex": _CAPEX_BASE.plus(
        "PaymentsToAcquireOilAndGasPropertyAndEquipment",
        "PaymentsToExploreAndDevelopOilAndGasProperties",
        "PaymentsToAcquireOilAndGasProperty",
    ),
    "CashAndEquivalents": _CASH.plus("Cash", _RESTRICTED_CASH),
}

BY_PROFILE: dict[str, dict[str, Candidate]] = {
    "alt_asset_manager": {
        "StockholdersEquity": balance(
            "StockholdersEquity", "LimitedPartnersCapitalAccount", "PartnersCapital"),
    },
    "financial": {
        "Revenue": ranked("RevenuesNetOfInterestExpense", "Revenues",
                          total("InterestIncomeExpenseNet", "NoninterestIncome")),
        "CashAndEquivalents": balance("CashAndCashEquivalentsAtCarryingValue",
                                      "CashAndDueFromBanks"),
        "Assets": balance("Assets"),
        "NetInterestIncome": flow("InterestIncomeExpenseNet"),
        "NoninterestExpense": flow("NoninterestExpense"),
        "DepreciationAndAmortization": ranked(
            "DepreciationDepletionAndAmortization",
            "DepreciationAndAmortization",
            "DepreciationAmortizationAndAccretionNet",
            total("Depreciation", "AmortizationOfIntangibleAssets",
                  "AmortizationOfMortgageServicingRightsMSRs"),
            "DepreciationNonproduction",
            "DepreciationPremisesAndEquipment",
            "CapitalizedComputerSoftwareAmortization",
        ),
        "ProvisionForCreditLosses": flow(
            "ProvisionForLoanLeaseAndOtherLosses",
            "ProvisionForLoanAndLeaseLosses",
            "ProvisionForLoanLossesExpensed",
        ),
        "NoninterestIncome": flow("NoninterestIncome"),
    },
    "insurance_pc": {
        "EarnedPremiums": flow("PremiumsEarnedNet", "PremiumsEarnedNetPropertyAndCasualty"),
        "IncurredLosses": flow("PolicyholderBenefitsAndClaimsIncurredNet",
                               "IncurredClaimsPropertyCasualtyAndLiability"),
        "BenefitsLossesAndExpenses": flow("BenefitsLossesAndExpenses"),
        "NetInvestmentIncome": flow("NetInvestmentIncome", "InvestmentIncomeNet"),
        "Investments": balance(
            "Investments",
            "InvestmentsFairValueDisclosure",
            "SummaryOfInvestmentsOtherThanInvestmentsInRelatedPartiesCarryingAmount",
        ),
        "ClaimsReserve": balance(
            "LiabilityForClaimsAndClaimsAdjustmentExpense",
            "LiabilityForClaimsAndClaimsAdjustmentExpensePropertyCasualtyLiability",
        ),
        "RealizedInvestmentGains": flow("RealizedInvestmentGainsLosses"),
        "LongTermDebt": ranked(
            *_LONG_DEBT, "SeniorLongTermNotes",
            total("SeniorNotes", "NotesPayable", "SubordinatedDebt"), point_in_time=True),
    },
    "insurance_life": {
        "EarnedPremiums": flow("PremiumsEarnedNet"),
        "IncurredLosses": flow("PolicyholderBenefitsAndClaimsIncurredNet"),
        "BenefitsLossesAndExpenses": flow("BenefitsLossesAndExpenses"),
        "NetInvestmentIncome": flow("NetInvestmentIncome"),
        "Investments": balance("Investments"),
        "ClaimsReserve": balance("LiabilityForFuturePolicyBenefits"),
        "RealizedInvestmentGains": ranked(
            total("GainLossOnSaleOfInvestments", "GainLossOnSaleOfOtherInvestments"),
            "GainLossOnInvestments"),
        "LongTermDebt": ranked(*_LONG_DEBT, "NotesPayable", point_in_time=True),
    },
    "retail": {
        "Inventory": balance("InventoryNet", "InventoryFinishedGoodsNetOfReserves",
                             "InventoryFinishedGoods", "RetailRelatedInventoryMerchandise"),
        "CostOfRevenue": flow("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"),
        "AccountsReceivable": balance(
            "AccountsReceivableNetCurrent", "ReceivablesNetCurrent",
            "AccountsReceivableTradeNetCurrent", "AccountsNotesAndLoansReceivableNetCurrent"),
        "AccountsPayable": balance("AccountsPayableCurrent", "AccountsPayableTradeCurrent"),
        "LongTermDebt": ranked(*_LONG_DEBT, "NotesPayable", "OtherBorrowings",
                               point_in_time=True),
    },
    "consumer_staples": {"CashAndEquivalents": _CASH.plus(_RESTRICTED_CASH)},
    "pharma_medtech": _HEALTH,
    "health_services": _HEALTH,
    "industrials": {
        "NetIncomeLoss": BASE["NetIncomeLoss"].plus("ProfitLoss"),
        "Capex": _CAPEX_BASE.plus(_OTHER_PLANT),
        "CashAndEquivalents": _CASH.plus(_RESTRICTED_CASH),
        "Revenue": _REVENUE.plus("SalesRevenueServicesNet"),
    },
    "media": {
        "Capex": _CAPEX_BASE.plus(_OTHER_PLANT),
        "CashAndEquivalents": _CASH.plus(_RESTRICTED_CASH),
    },
    "homebuilder": {
        "Inventory": balance("InventoryRealEstate", "InventoryOperativeBuilders"),
        "CostOfRevenue": flow("CostOfRevenue", "CostOfRealEstateRevenue",
                              "CostOfGoodsAndServicesSold"),
        "AccountsReceivable": balance("AccountsAndNotesReceivableNet"),
        "AccountsPayable": balance("AccountsPayableCurrentAndNoncurrent"),
        "LongTermDebt": ranked("LongTermDebt", "NotesPayable", "SeniorNotes",
                               point_in_time=True),
    },
    "utilities": {
        "CashAndEquivalents": _CASH.plus("Cash"),
        "Revenue": _REVENUE.plus("RegulatedAndUnregulatedOperatingRevenue", "UtilityRevenue"),
        "Capex": flow(
            "PaymentsToAcquireProductiveAssets",
            "PaymentsToAcquirePropertyPlantAndEquipment",
            "PaymentsToAcquireOtherProductiveAssets",
            _OTHER_PLANT,
        ),
        "DepreciationAndAmortization": BASE["DepreciationAndAmortization"].plus(
            "UtilitiesOperatingExpenseDepreciationAndAmortization"),
    },
    "energy": _OIL,
    "energy_integrated": _OIL,
    "reit": {
        "Revenue": flow(
            "Revenues",
            "RevenueFromContractWithCustomerExcludingAssessedTax",
            "SalesRevenueNet",
            "SalesRevenueGoodsNet",
            "RevenueFromContractWithCustomerIncludingAssessedTax",
        ),
        "GainLossOnSaleOfProperties": flow(
            "GainLossOnSaleOfProperties",
            "GainsLossesOnSalesOfInvestmentRealEstate",
            "GainLossOnSaleOfPropertiesNetOfTax",
            "GainLossOnDispositionOfRealEstate",
            "GainLossOnSaleOfPropertiesNetOfApplicableIncomeTaxes",
            "GainLossOnSaleOfPropertiesBeforeApplicableIncomeTaxes",
            "GainLossOnDispositionOfRealEstateDiscontinuedOperations",
            "GainsLossesOnSalesOfOtherRealEstate",
            "GainLossOnDispositionOfProperty",
            "GainLossOnSaleOfProperty",
            "GainLossOnSaleOfTimberProperty",
            "GainLossOnSaleOfPropertyPlantEquipment",
        ),
        "LongTermDebt": balance("NotesPayable", "LongTermDebt", "LongTermDebtNoncurrent"),
    },
}
# --- end of fixed values ----------------------------------------------------

Layer = Mapping[str, Mapping[str, Candidate]]


def candidate_from_mapping(cfg: Mapping) -> Candidate:
    """A candidate from its JSON form (modes fallback, priority_merge, sum,
    fallback_then_sum and fallback_sum)."""
    mode = cfg.get("mode", "fallback")
    if mode == "priority_merge":
        sources = [
            Source((s["tag"],)) if s["type"] == "tag"
            else Source(tuple(s["tags"]), "sum", s.get("require"))
            for s in cfg["sources"]
        ]
    elif mode == "sum":
        sources = [Source(tuple(cfg["tags"]), "sum")]
    else:
        sources = [Source((t,)) for t in cfg["tags"]]
        if mode == "fallback_then_sum":
            sources.append(Source(tuple(cfg["sum_tags"]), "sum"))
        elif mode == "fallback_sum":
            sources.append(Source(tuple(cfg["fallback_sum_tags"]), "sum", only_if_empty=True))
        elif mode != "fallback":
            raise ValueError(f"unknown mode {mode!r}")
    return Candidate(tuple(sources), bool(cfg["point_in_time"]),
                     bool(cfg.get("non_negative", False)))


def load_layer(path: str) -> dict[str, dict[str, Candidate]]:
    """A profile or company layer from JSON: ``{owner: {concept: {...}}}``."""
    with open(path, encoding="utf-8") as handle:
        raw = json.load(handle)
    return {owner: {c: candidate_from_mapping(cfg) for c, cfg in concepts.items()}
            for owner, concepts in raw.items()}


def _rows(owner: str, concepts: Mapping[str, Candidate]) -> Iterable[tuple]:
    for concept, candidate in concepts.items():
        for source_ix, source in enumerate(candidate.sources):
            roles = [(t, "term") for t in source.tags]
            if source.require:
                roles.append((source.require, "require"))
            for tag_ix, (tag, role) in enumerate(roles):
                yield (owner, concept, source_ix, tag_ix, tag, role, source.kind,
                       candidate.point_in_time, candidate.non_negative, source.only_if_empty)


def profile_sources_frame(
    spark: SparkSession,
    profiles: Iterable[str],
    base: Mapping[str, Candidate] = BASE,
    by_profile: Layer = BY_PROFILE,
) -> DataFrame:
    """Sources per profile, base and profile layer already merged (owner = profile)."""
    rows = [r for p in profiles for r in _rows(p, {**base, **by_profile.get(p, {})})]
    return spark.createDataFrame(rows, schemas.CONCEPT_SOURCES)


def company_sources_frame(spark: SparkSession, by_company: Layer | None = None) -> DataFrame:
    """Sources of the companies that override a concept (owner = ticker)."""
    rows = [r for t, concepts in (by_company or {}).items() for r in _rows(t, concepts)]
    return spark.createDataFrame(rows, schemas.CONCEPT_SOURCES)
