"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its greater neighbours at its least neighbour (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points its lesser neighbours and itself at the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b) between longs -> (node, root) for every node with an edge.

    ``root`` is the least node of the component.  Edges stay distributed: a round combines
    minima map-side and joins on a node, whose rows adaptive execution may split; a round's
    edges are at most those of the round before.  The number of rounds grows with the
    logarithm of the longest path.
    """
    scratch = Scratch(edges.sparkSession, "components")
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before, level = scratch.write(oriented.distinct(), "edges0"), None, 0
    while True:
        # an order-free sum tells whether a round has changed any edge
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        starred = _small_star(_large_star(now).distinct()).distinct()
        level += 1
        now, before = scratch.write(starred, f"edges{level}"), mark
        scratch.drop(f"edges{level - 1}")
