"""Concepts computed from other concepts of the same period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import Cell
from quarterdeck.operators.reshape import unpivot_states

ANNUAL_DERIVED = ("EPS_TTM_CALC", "TangibleEquity", "PPNR", "CoreOperatingEarnings", "FFO_TTM")
QUARTERLY_DERIVED = ("EPS_QUARTERLY_CALC", "PPNR_QUARTERLY", "CoreOperatingEarnings_QUARTERLY",
                     "FFO_QUARTERLY")
FOLDED_BACK = ("FCF_TTM", "EBITDA_TTM", "FCF_QUARTERLY", "EBITDA_QUARTERLY")
DERIVED = (*ANNUAL_DERIVED, *QUARTERLY_DERIVED, *FOLDED_BACK)


def _funds_from_operations(income: Cell, depreciation: Cell, gains: Cell) -> Cell:
    """Property gains are optional: a period without them counts as zero gains."""
    cash = income + depreciation
    return Cell(cash.value - F.coalesce(gains.value, F.lit(0.0)), cash.exists)


def with_derived(wide: DataFrame) -> DataFrame:
    c = Cell.of
    cells: dict[str, Cell] = {"TangibleEquity": c("StockholdersEquity") - c("Goodwill")}
    for suffix, eps, tail in (("_TTM", "EPS_TTM_CALC", ""),
                              ("", "EPS_QUARTERLY_CALC", "_QUARTERLY")):
        income = c(f"NetIncomeLoss{suffix}")
        depreciation = c(f"DepreciationAndAmortization{suffix}")
        period = suffix or "_QUARTERLY"
        cells[eps] = income / c("SharesOutstanding")
        cells[f"PPNR{tail}"] = (c(f"NetInterestIncome{suffix}") + c(f"NoninterestIncome{suffix}")
                                - c(f"NoninterestExpense{suffix}"))
        cells[f"CoreOperatingEarnings{tail}"] = income - c(f"RealizedInvestmentGains{suffix}")
        cells[f"FFO{period}"] = _funds_from_operations(
            income, depreciation, c(f"GainLossOnSaleOfProperties{suffix}"))
        cells[f"FCF{period}"] = c(f"OperatingCashFlow{suffix}") - c(f"Capex{suffix}")
        cells[f"EBITDA{period}"] = c(f"OperatingIncomeLoss{suffix}") + depreciation
    return wide.withColumns({name: cell.encoded() for name, cell in cells.items()})


def gains_source(wide_column: str = "GainLossOnSaleOfProperties_TTM"):
    return F.when(Cell.of(wide_column).value.isNotNull(), K.FFO_GAINS_REPORTED).otherwise(
        K.FFO_GAINS_IMPUTED)


def derived_rows(wide: DataFrame) -> DataFrame:
    """Derived concepts as long rows, with the provenance of the FFO gains term."""
    rows = unpivot_states(
        wide.withColumn("_gains", gains_source()), list(DERIVED), ("ticker", "end", "_gains"))
    return rows.select(
        "ticker", "concept", "end", "value",
        F.when(F.col("concept") == "FFO_TTM", F.col("_gains")).alias("ffo_gains_source"))
