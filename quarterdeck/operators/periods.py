"""Period ends that are a few days apart but mean the same quarter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.operators.timeseries import with_day


def with_cluster(df: DataFrame, keys: Sequence[str] = ("ticker",),
                 max_gap_days: int = K.CANONICAL_END_MAX_GAP_DAYS) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("day")
    gap = F.col("day") - F.lag("day").over(window)
    marked = df.withColumn("_starts", (gap.isNull() | (gap > max_gap_days)).cast("int"))
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("cluster", F.sum("_starts").over(running)).drop("_starts")


def majority_order(n_concepts: Column) -> Column:
    """Sort key: most concepts first, the later date on a tie."""
    return n_concepts.cast("long") * 1_000_000 + F.col("day")


def canonical_period_ends(facts: DataFrame, concepts: Sequence[str],
                          max_gap_days: int = K.CANONICAL_END_MAX_GAP_DAYS) -> DataFrame:
    """``(ticker, end)`` -> the end that carries most of the concepts in its cluster."""
    counted = with_day(
        facts.filter(F.col("concept").isin(*concepts))
        .groupBy("ticker", "end").agg(F.count_distinct("concept").alias("n")))
    clustered = with_cluster(counted, ("ticker",), max_gap_days)
    everyone = Window.partitionBy("ticker", "cluster")
    return clustered.select(
        "ticker", "end",
        F.max_by("end", majority_order(F.col("n"))).over(everyone).alias("canonical_end"))


def merge_duplicate_ends(series: DataFrame, keys: Sequence[str] = ("ticker", "concept"),
                         max_gap_days: int = K.DUPLICATE_END_MAX_GAP_DAYS) -> DataFrame:
    """Of a chain of ends at most a week apart only the last one survives."""
    window = Window.partitionBy(*keys).orderBy("day")
    following = F.lead("day").over(window) - F.col("day")
    return (with_day(series).withColumn("_following", following)
            .filter(F.col("_following").isNull() | (F.col("_following") > max_gap_days))
            .drop("_following", "day"))
