"""Raw filing facts to the clean long facts frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.operators import scale_repair as scale
from quarterdeck.operators.filing_periods import drop_known_bad, in_preferred_unit, of_tags
from quarterdeck.operators.periods import merge_duplicate_ends
from quarterdeck.operators.share_basis import apply_split_basis, corroborated_splits, restatements
from quarterdeck.operators.tag_merge import concept_series, drop_masked_periods, drop_negative
from quarterdeck.operators.timeseries import with_day, with_trailing_year_sum
from quarterdeck.session import cut_lineage, never_broadcast

SHARES = "SharesOutstanding"


def annual_ttm_rows(series: DataFrame, raw: DataFrame, sources: DataFrame,
                    concepts: Sequence[str] = K.TTM_CONCEPTS) -> DataFrame:
    """Twelve-month facts of series whose quarters form no trailing year at all.

    Judged on the quarterly series before any mask, per series rather than per date, so that
    rolling and annual values never mix.
    """
    listed = series.filter(F.col("concept").isin(*concepts))
    rolled = with_trailing_year_sum(with_day(listed), "value", "_ttm")
    has_window = rolled.filter(F.col("_ttm").isNotNull()).select("ticker", "concept").distinct()
    wanted = cut_lineage(sources.filter(F.col("concept").isin(*concepts)).join(
        never_broadcast(has_window), ["ticker", "concept"], "left_anti"))
    annual = merge_duplicate_ends(concept_series(raw, wanted, "annual"))
    return annual.select(
        "ticker", F.concat("concept", F.lit("_TTM")).alias("concept"), "end", "value",
        F.lit(K.TTM_ANNUAL).alias("ttm_source"))


def tags_of(sources: DataFrame, concept: str) -> DataFrame:
    return (sources.filter((F.col("concept") == concept) & (F.col("kind") == "tag"))
            .groupBy("ticker", "tag").agg(F.min("source_ix").alias("tag_ix")))


def on_split_basis(shares: DataFrame, cleaned: DataFrame, sources: DataFrame,
                   splits: DataFrame | None) -> DataFrame:
    """Share counts on the current split basis, with the ``filed_value``."""
    series = shares.withColumn("filed_value", F.col("value"))
    if splits is None:
        return series
    own = of_tags(cleaned, tags_of(sources, SHARES).select("ticker", "tag"))
    return apply_split_basis(series, corroborated_splits(splits, restatements(own)))


def share_evidence(cleaned: DataFrame, sources: DataFrame):
    """Share, EPS and income values as filed of the companies that have suspicious counts.

    The filings are read once, for their few tags; each call narrows what that left.
    """
    @cache
    def filed() -> list[DataFrame]:
        return [cut_lineage(scale.filing_values(cleaned, t))
                for t in (tags_of(sources, SHARES), scale.eps_tags(cleaned), tags_of(sources, "NetIncomeLoss"))]

    def evidence_for(suspects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        companies = suspects.select("ticker").distinct()
        return tuple(values.join(companies, "ticker", "left_semi") for values in filed())

    return evidence_for


def repair_share_counts(shares: DataFrame, cleaned: DataFrame, sources: DataFrame,
                        splits: DataFrame | None) -> DataFrame:
    """Split basis first, unit scale second: a split is no power of ten."""
    series, evidence_for = on_split_basis(shares, cleaned, sources, splits), share_evidence(cleaned, sources)
    return scale.directional_repair(scale.corroborated_scale(series, evidence_for), evidence_for)


def build_facts(raw: DataFrame, sources: DataFrame, splits: DataFrame | None = None,
                known_bad: DataFrame | None = None, masked: DataFrame | None = None,
                annual_ttm_concepts: Sequence[str] = K.TTM_CONCEPTS) -> DataFrame:
    """Clean quarterly facts plus annual TTM rows of all companies at once."""
    cleaned = raw if known_bad is None else cut_lineage(drop_known_bad(raw, known_bad))
    readable = cut_lineage(in_preferred_unit(cleaned))
    sources = cut_lineage(sources)
    series = cut_lineage(merge_duplicate_ends(concept_series(readable, sources, "quarterly")))
    annual = annual_ttm_rows(series, readable, sources, annual_ttm_concepts)
    columns = ["ticker", "concept", "end", "value", "filed"]
    repaired = repair_share_counts(
        series.filter(F.col("concept") == SHARES).select(*columns), cleaned, sources, splits)
    quarterly = series.filter(F.col("concept") != SHARES).select(*columns).unionByName(
        repaired.select(*columns))
    quarterly = drop_negative(quarterly)
    if masked is not None:
        quarterly = drop_masked_periods(quarterly, masked)
    return quarterly.select(
        "ticker", "concept", "end", "value", F.lit(None).cast("string").alias("ttm_source")
    ).unionByName(annual)
