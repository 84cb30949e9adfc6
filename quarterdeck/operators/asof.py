"""Backward as-of matching of period ends against a price history.

Both sides meet in one window per company instead of a join on an inequality: period ends
and price rows are stacked, ordered by day, and each end reads the last price row above it.
A company contributes at most one price row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K


def asof_prices(ends: DataFrame, price_history: DataFrame,
                lookback_days: int = K.PRICE_LOOKBACK_DAYS) -> DataFrame:
    """``(ticker, end)`` -> ``close`` and ``market_price``.

    ``close`` comes from the last price row at or before the end, however old, and is null
    when that row carries no close.  ``market_price`` skips rows without a close but looks
    back at most ``lookback_days``.
    """
    prices = price_history.select(
        "ticker", F.col("date").alias("at"), F.lit(0).alias("side"),
        F.struct("date", "close").alias("quote"))
    wanted = ends.select(
        "ticker", F.col("end").alias("at"), F.lit(1).alias("side"),
        F.lit(None).cast("struct<date:date,close:double>").alias("quote"))
    so_far = (Window.partitionBy("ticker").orderBy("at", "side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    traded = F.when(F.col("quote.close").isNotNull(), F.col("quote"))
    matched = prices.unionByName(wanted).select(
        "ticker", "at", "side",
        F.last("quote", ignorenulls=True).over(so_far).alias("row"),
        F.last(traded, ignorenulls=True).over(so_far).alias("trade"),
    ).filter(F.col("side") == 1)
    fresh = F.datediff("at", "trade.date") <= lookback_days
    return matched.select(
        "ticker", F.col("at").alias("end"), F.col("row.close").alias("close"),
        F.when(fresh, F.col("trade.close")).alias("market_price"))


def last_price(ends: DataFrame, price_history: DataFrame) -> DataFrame:
    return asof_prices(ends, price_history).select("ticker", "end", "close")


def market_price(ends: DataFrame, price_history: DataFrame,
                 lookback_days: int = K.PRICE_LOOKBACK_DAYS) -> DataFrame:
    return asof_prices(ends, price_history, lookback_days).select(
        "ticker", "end", "market_price")
