"""The nightly job: raw filings and prices to a published run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck import registry
from quarterdeck.concept_sources import company_sources_frame, profile_sources_frame
from quarterdeck.operators.reshape import duplicate_warning
from quarterdeck.operators.filing_periods import drop_known_bad, in_preferred_unit
from quarterdeck.operators.tag_merge import expected_concepts, resolved_sources, shares_basis
from quarterdeck.operators.timeseries import add_growth_column, add_ttm_concepts
from quarterdeck.operators.visibility import drop_hidden
from quarterdeck.plans import freshness as fresh
from quarterdeck.plans.coverage import coverage_flags, coverage_report
from quarterdeck.plans.derived import derived_rows
from quarterdeck.plans.facts import build_facts
from quarterdeck.plans.metrics import metrics_long, metrics_wide
from quarterdeck.plans.snapshot import build_snapshot, build_snapshots_as_of
from quarterdeck.plans.valuation import (
    five_year_averages, harmonic_rows, peer_band_flags, valuation_history, valuation_wide,
)
from quarterdeck.session import cut_lineage
from quarterdeck.sources.prices import split_events
from quarterdeck.sources.published import growth_export, publish, universe


@dataclass(frozen=True)
class Inputs:
    """Landed tables of a run; the curated correction tables are optional."""

    requested: DataFrame
    raw_facts: DataFrame
    price_history: DataFrame
    quotes: DataFrame
    profiles: DataFrame
    submissions: DataFrame | None = None
    known_bad: DataFrame | None = None
    masked_periods: DataFrame | None = None
    company_sources: DataFrame | None = None


@dataclass(frozen=True)
class Calculated:
    facts: DataFrame
    metrics: DataFrame
    valuation: DataFrame
    averages: DataFrame
    snapshot: DataFrame
    wide: DataFrame


def calculate(facts: DataFrame, price_history: DataFrame, quotes: DataFrame,
              profiles: DataFrame, as_of, basis: DataFrame | None = None,
              submissions: DataFrame | None = None, cut: bool = True) -> Calculated:
    """Everything after extraction.  The frames several results share are written once."""
    stage = cut_lineage if cut else (lambda df: df)
    wide = stage(metrics_wide(facts, price_history))
    valued = stage(valuation_wide(wide, quotes))
    rows = harmonic_rows(valued)
    averages = five_year_averages(rows)
    snapshot = build_snapshot(wide, quotes, averages, as_of,
                              peer_band_flags(rows, profiles, as_of), basis)
    snapshot = snapshot.unionByName(fresh.staleness(facts, submissions, as_of))
    if submissions is not None:
        snapshot = snapshot.unionByName(fresh.filing_overdue(facts, submissions, as_of))
    full = add_ttm_concepts(facts).unionByName(derived_rows(wide), allowMissingColumns=True)
    return Calculated(full, metrics_long(wide), valuation_history(valued), averages, snapshot, wide)


def published_frames(result: Calculated, profiles: DataFrame, hidden: DataFrame
                     ) -> dict[str, DataFrame]:
    """Visible rows only; growth is added to the facts that are left.

    Profiles are cut: they are read once a frame and more, and long rows need not travel to meet a table known to be small.
    """
    profiles = cut_lineage(profiles)
    metrics = drop_hidden(result.metrics, profiles, hidden)
    history = drop_hidden(result.valuation, profiles, hidden)
    facts = add_growth_column(drop_hidden(result.facts, profiles, hidden))
    growth = growth_export(facts)
    return {
        "metrics_long": metrics,
        "valuation_history": history,
        "facts_growth": growth,
        "facts_full": facts,
        "current_snapshot": drop_hidden(result.snapshot, profiles, hidden),
        "universe": universe(metrics, history, growth, profiles),
    }


def written_once(frames: dict[str, DataFrame], profiles: DataFrame) -> dict[str, DataFrame]:
    """The same frames for ``publish``, which reads each twice: the dear ones are cut, what counts them reads the cut."""
    frames = frames | {name: cut_lineage(frames[name]) for name in ("facts_full", "current_snapshot")}
    growth = growth_export(frames["facts_full"])
    return frames | {"facts_growth": growth, "universe": cut_lineage(
        universe(frames["metrics_long"], frames["valuation_history"], growth, profiles))}


def refresh(inputs: Inputs, root: str, run_id: str, as_of) -> dict:
    """Run the whole job and publish it; returns the manifest."""
    started = datetime.now()
    spark = inputs.requested.sparkSession
    companies = inputs.requested.select("ticker").distinct()
    raw = inputs.raw_facts.join(companies, "ticker", "left_semi")
    own = inputs.company_sources
    sources = resolved_sources(
        companies, inputs.profiles, profile_sources_frame(spark, registry.profile_names()),
        company_sources_frame(spark) if own is None else own)
    readable = in_preferred_unit(raw if inputs.known_bad is None else drop_known_bad(raw, inputs.known_bad))
    facts = cut_lineage(build_facts(
        raw, sources, split_events(inputs.price_history), inputs.known_bad,
        inputs.masked_periods))
    expected = expected_concepts(sources, inputs.profiles, registry.excluded_frame(spark))
    coverage = coverage_report(coverage_flags(facts, expected), inputs.profiles)
    coverage.write.parquet(f"{root}/{run_id}/coverage")
    # before anything groups by the key
    duplicate_warning(facts).write.parquet(f"{root}/{run_id}/duplicates")
    result = calculate(facts, inputs.price_history, inputs.quotes, inputs.profiles, as_of,
                       shares_basis(readable, sources), inputs.submissions)
    frames = published_frames(result, inputs.profiles, registry.hidden_frame(spark))
    return publish(written_once(frames, inputs.profiles), companies, root, run_id, started)


def as_of_snapshots(result: Calculated, price_history: DataFrame, cutoffs: list[str],
                    profiles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible snapshot rows for a list of past dates."""
    out = build_snapshots_as_of(cutoffs, result.wide, price_history, result.averages)
    return drop_hidden(out, profiles, hidden).orderBy("ticker", F.col("end"), "concept")
