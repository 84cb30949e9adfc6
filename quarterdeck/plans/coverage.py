"""Concepts a company should report but hardly does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.operators.visibility import with_profile
from quarterdeck.registry import hints_frame


def coverage_flags(facts: DataFrame, expected: DataFrame,
                   threshold: float = K.COVERAGE_THRESHOLD) -> DataFrame:
    """Rows of ``expected(ticker, concept)`` covered below ``threshold`` of the best concept.

    Only companies that have any fact are judged; an expected concept without rows counts 0.
    """
    counted = facts.groupBy("ticker", "concept").agg(F.count(F.lit(1)).alias("rows"))
    present = counted.groupBy("ticker").agg(F.count(F.lit(1)).alias("_any")).select("ticker")
    joined = (expected.distinct().join(present, "ticker", "left_semi")
              .join(counted, ["ticker", "concept"], "left")
              .withColumn("count", F.coalesce("rows", F.lit(0))))
    best = F.max("count").over(Window.partitionBy("ticker"))
    return (joined.withColumn("max_for_ticker", best)
            .withColumn("ratio", F.try_divide(F.col("count").cast("double"),
                                              F.col("max_for_ticker").cast("double")))
            .filter(F.col("ratio") < threshold)
            .select("ticker", "concept", "count", "max_for_ticker", "ratio"))


def coverage_report(flags: DataFrame, profiles: DataFrame) -> DataFrame:
    """Coverage flags with profile, marker and the keywords to search for."""
    hints = F.broadcast(hints_frame(flags.sparkSession))
    return with_profile(flags, profiles).join(hints, "concept", "left").select(
        "profile", "ticker", "concept",
        F.when(F.col("count") == 0, "MISSING").otherwise("thin").alias("marker"),
        "count", "max_for_ticker", "ratio", "hint")
