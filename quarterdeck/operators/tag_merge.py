"""Several tags to one concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.operators.filing_periods import tag_series
from quarterdeck.operators.visibility import with_profile
from quarterdeck.session import never_broadcast

CONFIG = ("concept", "source_ix", "tag_ix", "tag", "role", "kind", "point_in_time",
          "non_negative", "only_if_empty")


def resolved_sources(companies: DataFrame, profiles: DataFrame, profile_sources: DataFrame,
                     company_sources: DataFrame) -> DataFrame:
    """Candidate sources of every company; a company layer replaces a concept as a whole.

    ``profile_sources`` and ``company_sources`` are configuration, not data.
    """
    by_profile = with_profile(companies.select("ticker").distinct(), profiles).join(
        profile_sources.withColumnRenamed("owner", "profile"), "profile")
    own = company_sources.withColumnRenamed("owner", "ticker")
    replaced = own.select("ticker", "concept").distinct()
    inherited = by_profile.join(replaced, ["ticker", "concept"], "left_anti")
    mine = own.join(companies.select("ticker").distinct(), "ticker", "left_semi")
    return inherited.select("ticker", *CONFIG).unionByName(mine.select("ticker", *CONFIG))


def expected_concepts(sources: DataFrame, profiles: DataFrame, excluded: DataFrame) -> DataFrame:
    """Concepts a company is expected to report."""
    wanted = with_profile(sources.select("ticker", "concept").distinct(), profiles)
    return wanted.join(excluded, ["profile", "concept"], "left_anti").select(
        "ticker", "concept")


def sum_of_tags(series: DataFrame, sources: DataFrame) -> DataFrame:
    """Value per source and end: the sum of the terms present, where a required tag exists.

    A single tag is a sum of one.  Filing dates only survive for single tags; ``with_tag``
    adds the tag's name.
    """
    source = Window.partitionBy("ticker", "concept", "source_ix")
    marked = sources.withColumn("_requires", F.max(F.col("role") == "require").over(source))
    rows = series.join(never_broadcast(marked), ["ticker", "tag"])
    term = F.col("role") == "term"
    needs = (F.col("kind") == "sum") & (F.col("role") == "require")
    merged = rows.groupBy("ticker", "concept", "source_ix", "end").agg(
        F.sum(F.when(term, F.col("value"))).alias("value"),
        F.count(F.when(term, 1)).alias("_terms"),
        F.count(F.when(needs, 1)).alias("_required_seen"),
        F.max(F.when(F.col("kind") == "tag", F.col("filed"))).alias("filed"),
        F.max("non_negative").alias("non_negative"),
        F.max("only_if_empty").alias("only_if_empty"),
        F.max("_requires").alias("_requires"))
    return merged.filter((F.col("_terms") > 0)
                         & (~F.coalesce("_requires", F.lit(False)) | (F.col("_required_seen") > 0)))


def first_source_wins(candidates: DataFrame) -> DataFrame:
    """Per end the value of the first source that has one.

    Sources that must not go negative are filtered before the choice.  A source marked for
    use only when all others are empty is dropped where the series has any other row.
    """
    allowed = (~F.coalesce("non_negative", F.lit(False)) | F.col("value").isNull()
               | (F.col("value") >= 0))
    usable = candidates.filter(allowed)
    chosen = usable.groupBy("ticker", "concept", "end").agg(
        F.min_by("value", "source_ix").alias("value"),
        F.min_by("filed", "source_ix").alias("filed"),
        F.min_by("only_if_empty", "source_ix").alias("_last_resort"),
        F.min("source_ix").alias("source_ix"))
    # the reduced rows of a series are bounded by the calendar
    series = Window.partitionBy("ticker", "concept")
    others = F.max(~F.col("_last_resort")).over(series)
    return chosen.withColumn("_others", others).filter(~F.col("_last_resort") | ~F.col("_others")).drop(
        "_last_resort", "_others")


def with_tag(series: DataFrame, sources: DataFrame) -> DataFrame:
    """Name the tag behind each value; null where several tags were added up.

    Names are looked up by position, so no aggregate has to carry strings.
    """
    names = sources.filter((F.col("kind") == "tag") & (F.col("role") == "term")).groupBy(
        "ticker", "concept", "source_ix", "tag").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return series.join(never_broadcast(names), ["ticker", "concept", "source_ix"], "left").drop("source_ix")


def concept_series(raw: DataFrame, sources: DataFrame, period: str = "quarterly") -> DataFrame:
    """``(ticker, concept, end, value, filed, tag)`` from raw facts and resolved sources.

    Raw facts are narrowed by the names of tags alone, so none travels; what is left of a tag meets its company's sources.
    """
    merged = None
    for point_in_time in (False, True):
        wanted = sources.filter(F.col("point_in_time") == point_in_time)
        needed = raw.join(F.broadcast(wanted.select("tag").distinct()), "tag", "left_semi").select(raw.columns)
        part = sum_of_tags(tag_series(needed, period, point_in_time), wanted)
        merged = part if merged is None else merged.unionByName(part)
    return with_tag(first_source_wins(merged), sources).select(
        "ticker", "concept", "end", "value", "filed", "tag")


def drop_negative(series: DataFrame) -> DataFrame:
    """Flows and balances that cannot be negative lose such rows; missing values stay."""
    guarded = F.col("concept").isin(*K.NON_NEGATIVE_FLOWS, *K.NON_NEGATIVE_BALANCES)
    return series.filter(~guarded | F.col("value").isNull() | (F.col("value") >= 0))


def drop_masked_periods(series: DataFrame, masked: DataFrame) -> DataFrame:
    """Remove curated ``(ticker, concept, end)`` periods."""
    return series.join(never_broadcast(masked.select("ticker", "concept", "end")),
                       ["ticker", "concept", "end"], "left_anti")


def shares_basis(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Numeric code of the basis behind each company's newest share count."""
    shares = concept_series(raw, sources.filter(F.col("concept") == "SharesOutstanding"))
    code = (F.when(F.col("tag").isin(*K.WEIGHTED_SHARE_TAGS),
                   F.lit(K.SHARES_BASIS_CODES["diluted_wavg"]))
            .when(F.col("tag").isin(*K.PERIOD_END_SHARE_TAGS),
                  F.lit(K.SHARES_BASIS_CODES["period_end"])))
    return shares.withColumn("_code", code).groupBy("ticker").agg(
        F.max_by("_code", "end").alias("shares_basis")).filter("shares_basis IS NOT NULL")
