"""Share counts on one split basis.

A count is stated on the basis in force when it was filed.  A split is applied only when the
company's own restatements confirm it.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K

# width of a ratio bucket on the log scale; not below the match tolerance
_RATIO_BUCKET = K.SPLIT_MATCH_TOLERANCE


def restatements(raw: DataFrame) -> DataFrame:
    """``(ticker, tag, unit, end, earlier, later, ratio)`` for periods reported twice.

    Among the numbers of one filing day only the largest meets the next filing day and only
    the smallest meets the previous one, so a day is reduced to two numbers before anything
    is ordered.
    """
    per_day = (raw.filter(F.col("val").isNotNull() & (F.col("val") != 0))
               .groupBy("ticker", "tag", "unit", "end", "filed")
               .agg(F.min("val").alias("smallest"), F.max("val").alias("largest")))
    window = Window.partitionBy("ticker", "tag", "unit", "end").orderBy("filed")
    pairs = per_day.withColumns({"earlier": F.lag("filed").over(window),
                                 "_before": F.lag("largest").over(window)})
    return pairs.filter((F.col("_before") > 0) & (F.col("smallest") > 0)).select(
        "ticker", "tag", "unit", "end", "earlier", F.col("filed").alias("later"),
        (F.col("smallest") / F.col("_before")).alias("ratio"))


def _bucket(log_ratio):
    return F.floor(log_ratio / _RATIO_BUCKET).cast("int")


def corroborated_splits(splits: DataFrame, changes: DataFrame) -> DataFrame:
    """Split events that some restatement across the split day confirms.

    Events and restatements meet on company and ratio bucket, never on company alone.
    """
    events = splits.filter(F.col("ratio") > 0).withColumn("_log", F.ln("ratio")).filter(
        F.abs("_log") >= K.SPLIT_MIN_LOG_MAGNITUDE)
    probes = events.select(
        "ticker", "date", "ratio", "_log",
        F.explode(F.array(*[_bucket(F.col("_log")) + k for k in (-1, 0, 1)])).alias("_bucket"))
    seen = changes.withColumn("_seen", F.ln("ratio")).select(
        "ticker", "earlier", "later", "_seen", _bucket(F.col("_seen")).alias("_bucket")).distinct()
    straddles = (probes["date"] > seen["earlier"]) & (probes["date"] <= seen["later"])
    close = F.abs(seen["_seen"] - probes["_log"]) < K.SPLIT_MATCH_TOLERANCE
    hit = probes.join(seen, (probes["ticker"] == seen["ticker"])
                      & (probes["_bucket"] == seen["_bucket"]) & straddles & close, "left_semi")
    return hit.select("ticker", "date", "ratio").distinct()


def apply_split_basis(series: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Multiply each value by the confirmed splits that came after its filing.

    A company has one confirmed event per day at most, so its list of events is short.
    """
    events = confirmed.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("date", "ratio"))).alias("_events"))
    later = F.filter("_events", lambda e: e["date"] > F.col("filed"))
    factor = F.aggregate(later, F.lit(1.0), lambda acc, e: acc * e["ratio"])
    joined = series.join(events, "ticker", "left")
    known = F.col("filed").isNotNull() & F.col("_events").isNotNull()
    return joined.withColumn(
        "value", F.when(known, F.col("value") * factor).otherwise(F.col("value"))).drop("_events")


