"""Exact group medians that stay distributed when one group is huge.

``percentile`` keeps every distinct value of a group in one task.  That is fine for a
company's own series (bounded by the calendar), not for a peer group or a whole universe.
Here equal values are counted first.  The middle is then found in three steps down an ordered
tree: sign and exponent with the leading bits of the fraction, further bits, and the values
themselves.  Each step looks only into the cells that hold the middle, and a group has a
bounded number of cells at each, at any scale of its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# bits of the fraction that the first and the second step tell apart
FIRST_BITS, SECOND_BITS = 8, 20


def _cell(bits: int) -> Column:
    """Number of the cell of ``_v``, in the order of the values: exponent, then ``bits`` of the fraction."""
    size = F.abs("_v")
    exponent = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << bits))
    place = (exponent + 1100) * (1 << bits) + fraction
    return F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * place).cast("long")


def _holding(counts: DataFrame, keys: list[str], cell: str, known: list[str]) -> DataFrame:
    """The cells of each group that hold a middle, and how many values lie before each."""
    within = Window.partitionBy(*keys, *known).orderBy(cell)
    cells = counts.groupBy(*keys, *known, "_before", "_low", "_high", cell).agg(F.sum("_n").alias("_in"))
    cells = cells.withColumn("_upto", F.col("_before") + F.sum("_in").over(within))
    cells = cells.withColumn("_before", F.col("_upto") - F.col("_in"))
    return cells.filter((F.col("_before") <= F.col("_high")) & (F.col("_upto") > F.col("_low"))).drop("_in", "_upto")


def _middles(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    """Lower and upper middle of every group."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).alias("_v")).agg(n.alias("_n"))
              .withColumns({"_first": _cell(FIRST_BITS), "_second": _cell(SECOND_BITS)}))
    group = Window.partitionBy(*keys)
    coarse = counts.groupBy(*keys, "_first").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(group)
    coarse = coarse.withColumns({"_before": F.lit(0).cast("long"), "_low": F.floor((total - 1) / 2),
                                 "_high": F.floor(total / 2)})
    for step, known in (("_first", []), ("_second", ["_first"])):
        held = _holding(coarse, keys, step, known)
        inside = counts.join(held, [*keys, *known, step])
        coarse = inside
    so_far = F.sum("_n").over(Window.partitionBy(*keys, "_first", "_second").orderBy("_v"))
    ranked = inside.withColumn("_upto", F.col("_before") + so_far)
    holds = lambda rank: ((F.col("_upto") > F.col(rank))
                          & (F.col("_upto") - F.col("_n") <= F.col(rank)))
    return ranked.filter(holds("_low") | holds("_high")).groupBy(*keys).agg(
        F.max(F.when(holds("_low"), F.col("_v"))).alias("_lower"),
        F.max(F.when(holds("_high"), F.col("_v"))).alias("_upper"))


def group_upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                       weight: str | None = None) -> DataFrame:
    """Element ``n // 2`` of every sorted group (the upper of two middles)."""
    return _middles(df, list(keys), value, weight).select(*keys, F.col("_upper").alias(name))


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 weight: str | None = None) -> DataFrame:
    """Exact median (mean of the two middles) of every group."""
    return _middles(df, list(keys), value, weight).select(
        *keys, ((F.col("_lower") + F.col("_upper")) / 2).alias(name))
