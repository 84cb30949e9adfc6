"""Profile lookups and the visibility filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.constants import DEFAULT_PROFILE


def with_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach the company's profile; unknown companies get the default one."""
    known = profiles.select("ticker", F.col("profile").alias("_profile"))
    return (df.join(known, "ticker", "left")
            .withColumn("profile", F.coalesce("_profile", F.lit(DEFAULT_PROFILE)))
            .drop("_profile"))


def drop_hidden(df: DataFrame, profiles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows whose concept is shown for the company's profile.

    ``hidden(profile, concept)`` is configuration (a few thousand names at most), so rows do not travel to meet it.
    Spark can't tell its size.
    """
    columns = df.columns
    tagged = with_profile(df, profiles)
    return tagged.join(F.broadcast(hidden), ["profile", "concept"], "left_anti").select(*columns)
