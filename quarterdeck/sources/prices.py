"""Landed price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.cells import MISSING


def price_history(rows: DataFrame) -> DataFrame:
    """``(ticker, date, close, stock_split)`` with one row per company and day.

    A feed without a split column has no splits.  Repeated days are combined before the
    shuffle, so a heavily repeated company costs no more than its calendar.
    """
    if "stock_split" not in rows.columns:
        rows = rows.withColumn("stock_split", F.lit(0.0))
    close = F.when(~F.isnan("close") & (F.col("close") > MISSING), F.col("close"))
    return rows.groupBy("ticker", F.col("date").cast("date").alias("date")).agg(
        F.max(close).alias("close"),
        F.coalesce(F.max("stock_split"), F.lit(0.0)).alias("stock_split"))


def read_price_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    # files from before a column was added lack it
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read.option("mergeSchema", True)
    if fmt == "csv":
        reader = reader.schema("ticker string, date timestamp, close double, stock_split double")
    return price_history(reader.format(fmt).load(path))


def quotes(rows: DataFrame) -> DataFrame:
    """Current quotes with market capitalisation."""
    return rows.select("ticker", "price", "shares_outstanding",
                       (F.col("price") * F.col("shares_outstanding")).alias("market_cap"))


def split_events(history: DataFrame) -> DataFrame:
    return history.filter(F.col("stock_split") != 0).select(
        "ticker", "date", F.col("stock_split").alias("ratio"))
