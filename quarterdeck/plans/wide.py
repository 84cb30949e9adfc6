"""The wide frame: one row per company and period end, built with one exchange.

Long facts are hash-distributed by company once, over tasks by their number.  The series windows (TTM, growth, previous
quarter), the pivot to one row per period and every later window over a company's periods
all need a finer grouping of that same distribution, so none of them shuffles again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.cells import encode
from quarterdeck.operators.asof import asof_prices
from quarterdeck.operators.timeseries import (
    series_window, with_day, with_growth, with_trailing_year_sum,
)
from quarterdeck.session import cut_lineage, dealt_by_rows

BALANCES = (
    "SharesOutstanding", "StockholdersEquity", "Goodwill", "LongTermDebt", "CashAndEquivalents",
    "Assets", "Investments", "ClaimsReserve", "Inventory", "AccountsReceivable", "AccountsPayable",
)
RAW = tuple(dict.fromkeys((*K.TTM_CONCEPTS, *BALANCES)))
TTM = tuple(f"{c}_TTM" for c in K.TTM_CONCEPTS)
GROWTH_OF = {
    "Revenue_TTM": "g_revenue",
    "NetIncomeLoss_TTM": "g_income",
    "OperatingIncomeLoss_TTM": "g_operating_income",
    "ClaimsReserve": "g_reserve",
}
PREVIOUS_OF = {"StockholdersEquity": "equity", "Goodwill": "goodwill", "SharesOutstanding": "shares"}
CLOSE, MARKET_PRICE = "_close", "_market_price"


def price_rows(ends: DataFrame, price_history: DataFrame) -> DataFrame:
    """As-of prices of every period end as rows of two extra concepts."""
    matched = asof_prices(ends.select("ticker", "end"), price_history)
    quotes = F.array(
        F.struct(F.lit(CLOSE).alias("concept"), F.col("close").alias("value")),
        F.struct(F.lit(MARKET_PRICE).alias("concept"), F.col("market_price").alias("value")))
    return matched.select("ticker", "end", F.inline(quotes)).filter(F.col("value").isNotNull())


def series_rows(facts: DataFrame, price_history: DataFrame | None = None) -> DataFrame:
    """Long rows with their TTM sum, growth and previous quarter."""
    listed = F.col("concept").isin(*RAW, *TTM)
    long = facts.filter(listed).select("ticker", "end", "concept", "value")
    if price_history is None:
        rows = long.count()
    else:
        # period ends and the number of rows come from one reading of the facts
        ends = cut_lineage(facts.groupBy("ticker", "end").agg(F.count_if(listed).alias("rows")))
        rows = ends.agg(F.sum("rows")).first()[0] or 0
        long = long.unionByName(price_rows(ends, price_history))
    window = series_window()
    rows = with_trailing_year_sum(with_day(dealt_by_rows(long, rows, "ticker")), "value", "ttm", window)
    rows = rows.withColumns({"prev_value": F.lag("value").over(window),
                             "prev_day": F.lag("day").over(window)})
    return with_growth(rows, {"value": "growth", "ttm": "ttm_growth"}, window)


def _pick(name: str, **sources: str) -> str:
    """Aggregate in SQL: the column of the row whose concept matches, else null."""
    cases = " ".join(f"WHEN concept = '{c}' THEN {column}" for c, column in sources.items())
    return f"max(CASE {cases} END) AS `{name}`"


def build_wide(facts: DataFrame, price_history: DataFrame | None = None) -> DataFrame:
    """Raw concepts, TTM concepts, their growth, previous quarters and prices per period.

    Keys of ``facts`` are unique (``reshape.duplicates`` tells).  Where a series has annual
    TTM facts, those stand in for its missing rolling sums.
    """
    rows = series_rows(facts, price_history).withColumns(
        {"state": encode(F.col("value")), "ttm_state": encode(F.col("ttm"))})
    picks = ["max(day) AS day"]
    picks += [_pick(c, **{c: "state"}) for c in RAW]
    picks += [_pick(f"{c}_TTM", **{c: "ttm_state", f"{c}_TTM": "state"}) for c in K.TTM_CONCEPTS]
    for concept, column in GROWTH_OF.items():
        rolled = {concept.removesuffix("_TTM"): "ttm_growth"} if concept.endswith("_TTM") else {}
        picks.append(_pick(column, **rolled, **{concept: "growth"}))
    for concept, column in PREVIOUS_OF.items():
        picks.append(_pick(f"prev_{column}", **{concept: "prev_value"}))
        picks.append(_pick(f"prev_{column}_day", **{concept: "prev_day"}))
    picks += [_pick(name, **{name: "value"}) for name in (CLOSE, MARKET_PRICE)]
    return rows.groupBy("ticker", "end").agg(*[F.expr(p) for p in picks])
