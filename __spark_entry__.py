
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.common import AS_OF, CUTOFF, CUTOFFS
from quarterdeck import concept_sources as C
from quarterdeck import constants as K
from quarterdeck import registry as R
from quarterdeck.functions.quantiles import group_median, group_upper_median
from quarterdeck.operators import asof, filing_periods, periods, ratios, reshape, tag_merge
from quarterdeck.operators import scale_repair, share_basis, timeseries as ts, visibility
from quarterdeck.plans import coverage, derived, facts as facts_plan, freshness, metrics
from quarterdeck.plans import refresh, snapshot, valuation, views, wide as wide_plan
from quarterdeck.session import cut_lineage, shared_folder
from quarterdeck.sources import filings, prices, published
from quarterdeck.sources import tables as T

try:
    from quarterdeck.llm import queries as llm_queries
except ImportError:
    llm_queries = None

#: queries about absence read facts and prices that lack some values
ABOUT_GAPS = frozenset("coverage_report latest_values latest_rows scale_reference coverage_flags empty_panels null_columns "
                       "available_concepts share_history_absent tickers_without_data".split())
SMOKE_DIR = "/root/testdata/sf0.001"
YEARS = 5


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Small numbers to six decimals: engines differ in the last bits of long sums."""
    return df.withColumns({c: F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(F.col(c))
                           for c in columns})


class Data:
    """The given tables read as fundamentals inputs; every frame is built on demand.

    Frames that a query reads several times are written once to the shared folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, gaps: bool = False):
        self.spark, self.sf_dir, self.gaps = spark, sf_dir, gaps

    def table(self, name: str) -> DataFrame:
        return T.read_table(self.spark, self.sf_dir, name)

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def sums(self) -> DataFrame:
        """Line items by supplier and quarter, which facts and filings are made of."""
        return cut_lineage(T.quarter_sums(self.lineitem))

    @property
    def facts(self) -> DataFrame:
        return T.facts_from_sums(self.sums, gaps=self.gaps)

    @property
    def sparse(self) -> DataFrame:
        return T.sparse_facts_from_orders(self.table("orders"))

    @property
    def prices(self) -> DataFrame:
        return T.prices_from_lineitem(self.lineitem, self.gaps)

    @property
    def quotes(self) -> DataFrame:
        return T.quotes_from_lineitem(self.lineitem)

    @property
    def profiles(self) -> DataFrame:
        return T.profiles_from_suppliers(self.table("supplier"), self.table("nation"))

    @property
    def submissions(self) -> DataFrame:
        return T.submissions_from_lineitem(self.lineitem)

    @property
    def hidden(self) -> DataFrame:
        return R.hidden_frame(self.spark)

    @property
    def full(self) -> DataFrame:
        """Facts with their trailing-year and derived concepts."""
        return self.full_of(derived.with_derived(wide_plan.build_wide(self.facts)))

    def full_of(self, wide: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
        """``full`` out of a wide frame that is there; with ``only``, its rows of these concepts."""
        facts, rows = self.facts, derived.derived_rows(wide)
        if only:
            # a concept and its trailing-year concept are made of each other, and of no third
            facts = facts.filter(F.col("concept").isin(*only, *[c.removesuffix("_TTM") for c in only]))
        full = ts.add_ttm_concepts(facts).unionByName(rows, allowMissingColumns=True)
        return full.filter(F.col("concept").isin(*only)) if only else full

    @property
    def wide(self) -> DataFrame:
        return metrics.metrics_wide(self.facts, self.prices)

    @cached_property
    def shared_wide(self) -> DataFrame:
        return cut_lineage(self.wide)

    @property
    def wide_without_prices(self) -> DataFrame:
        return metrics.metrics_wide(self.facts)

    @property
    def valued(self) -> DataFrame:
        return valuation.valuation_wide(self.wide, self.quotes)

    @property
    def history(self) -> DataFrame:
        return valuation.valuation_history(self.valued)

    @property
    def metrics(self) -> DataFrame:
        return metrics.metrics_long(self.wide)

    @cached_property
    def raw(self) -> DataFrame:
        return cut_lineage(T.raw_filings_from_lineitem(self.lineitem, self.sums))

    @cached_property
    def readable(self) -> DataFrame:
        return cut_lineage(filing_periods.in_preferred_unit(self.raw))

    @cached_property
    def sources(self) -> DataFrame:
        return cut_lineage(tag_merge.resolved_sources(
            self.profiles, self.profiles,
            C.profile_sources_frame(self.spark, R.profile_names()),
            C.company_sources_frame(self.spark)))

    @cached_property
    def series(self) -> DataFrame:
        return cut_lineage(periods.merge_duplicate_ends(
            tag_merge.concept_series(self.readable, self.sources)))

    def series_of(self, concept: str) -> DataFrame:
        """The series of one concept, out of the facts of its tags alone: nothing in it depends on other tags."""
        sources = self.sources.filter(F.col("concept") == concept)
        raw = filing_periods.of_tags(self.raw, sources.select("ticker", "tag").distinct())
        return periods.merge_duplicate_ends(tag_merge.concept_series(
            cut_lineage(filing_periods.in_preferred_unit(raw)), sources))

    @cached_property
    def share_counts(self) -> DataFrame:
        return cut_lineage(self.series_of(facts_plan.SHARES).select("ticker", "concept", "end", "value", "filed"))

    @property
    def share_restatements(self) -> DataFrame:
        tags = [t for s in C.BASE["SharesOutstanding"].sources for t in s.tags]
        return share_basis.restatements(self.raw.filter(F.col("tag").isin(*tags)))

    @property
    def confirmed_splits(self) -> DataFrame:
        return share_basis.corroborated_splits(
            prices.split_events(self.prices), self.share_restatements)


QUERIES: dict[str, Callable[[Data], DataFrame]] = {}


def query(build: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# --- time series ------------------------------------------------------------

@query
def ttm_quarterly(d: Data) -> DataFrame:
    both = None
    for facts, concepts in ((d.facts, K.TTM_CONCEPTS), (d.sparse, ("Revenue",))):
        rows = ts.with_trailing_year_sum(
            ts.with_day(facts.filter(F.col("concept").isin(*concepts))), "value", "ttm")
        part = rows.select("ticker", F.concat("concept", F.lit("_TTM")).alias("concept"), "end",
                           F.col("ttm").alias("value"))
        both = part if both is None else both.unionByName(part)
    return both


@query
def growth_yoy(d: Data) -> DataFrame:
    sparse = ts.calculate_growth(d.sparse, "Revenue", 4, "yoy_growth").withColumn(
        "concept", F.lit("Revenue"))
    return ts.add_growth_column(d.full).select(
        "ticker", "concept", "end", "value", "yoy_growth").unionByName(sparse)


@query
def revenue_ttm_growth(d: Data) -> DataFrame:
    return ts.calculate_growth(
        ts.add_ttm_concepts(d.facts.filter(F.col("concept") == "Revenue")), "Revenue_TTM", 4,
        "yoy_growth")


@query
def latest_values(d: Data) -> DataFrame:
    return ts.latest_value(d.facts)


@query
def latest_rows(d: Data) -> DataFrame:
    return ts.latest_row(d.facts, ("ticker", "concept"))


@query
def scale_reference(d: Data) -> DataFrame:
    rows = ts.calculate_ttm(d.facts, "Revenue", "revenue")
    return ts.scale_reference(rows, "revenue", "scale").select("ticker", "end", "scale")


@query
def pivot_periods(d: Data) -> DataFrame:
    facts = d.facts
    shown = ts.pivot_periods(facts, ["Revenue", "NetIncomeLoss", "Goodwill", "Capex"])
    return shown


# --- ratios and metrics -----------------------------------------------------

@query
def ratio_guarded(d: Data) -> DataFrame:
    facts = ts.add_ttm_concepts(d.facts.filter(
        F.col("concept").isin("NetIncomeLoss", "StockholdersEquity", "Revenue")))
    return ratios.calculate_ratio(facts, "NetIncomeLoss_TTM", "StockholdersEquity", "roe", True,
                                  "Revenue_TTM", K.METRIC_SCALE_RATIO)


@query
def margin_self_guarded(d: Data) -> DataFrame:
    facts = ts.add_ttm_concepts(d.facts.filter(
        F.col("concept").isin("OperatingIncomeLoss", "Revenue")))
    wide = ratios.pivot_states(facts, ["OperatingIncomeLoss_TTM", "Revenue_TTM"])
    above, below = ratios.Cell.of("OperatingIncomeLoss_TTM"), ratios.Cell.of("Revenue_TTM")
    margin = above / below
    rows = wide.filter(margin.exists).select(
        "ticker", "end", margin.value.alias("operating_margin"), below.value.alias("revenue"))
    return ts.self_scale_guard(rows, "operating_margin", "revenue").drop("revenue")


@query
def difference_and_sum(d: Data) -> DataFrame:
    facts = d.facts.filter(F.col("concept").isin("LongTermDebt", "CashAndEquivalents"))
    net = ratios.calculate_difference(facts, "LongTermDebt", "CashAndEquivalents", "net_debt")
    total = ratios.calculate_difference(facts, "LongTermDebt", "CashAndEquivalents", "total", "+")
    return net.join(total, ["ticker", "end"])


@query
def frame_ratio_limits(d: Data) -> DataFrame:
    names = ["LongTermDebt", "CashAndEquivalents", "OperatingIncomeLoss",
             "DepreciationAndAmortization"]
    facts = ts.add_ttm_concepts(d.facts.filter(F.col("concept").isin(*names)))
    debt = ratios.calculate_difference(facts, "LongTermDebt", "CashAndEquivalents", "net_debt")
    ebitda = ratios.calculate_difference(
        facts, "OperatingIncomeLoss_TTM", "DepreciationAndAmortization_TTM", "ebitda", "+")
    return ratios.ratio_of_frames(debt, ebitda, "net_debt", "ebitda", "net_debt_to_ebitda",
                                  K.NET_DEBT_EBITDA_MIN_EBITDA, K.NET_DEBT_EBITDA_MAX_ABS)


@query
def derived_concepts(d: Data) -> DataFrame:
    wide = derived.with_derived(wide_plan.build_wide(d.facts))
    return derived.derived_rows(wide).drop("ffo_gains_source")


@query
def metrics_long(d: Data) -> DataFrame:
    return d.metrics


@query
def qoq_flags(d: Data) -> DataFrame:
    wide = d.wide_without_prices
    return reshape.unpivot_states(wide, ["buyback_distortion_flag", "inorganic_contaminated"])


@query
def share_jump_flag(d: Data) -> DataFrame:
    return metrics.flag_rows(d.wide, "share_count_jump_flag")


@query
def duplicate_keys(d: Data) -> DataFrame:
    facts = d.facts
    return reshape.duplicates(facts.unionByName(facts.filter(F.col("concept") == "Goodwill")))


def _two_frames(d: Data) -> tuple[DataFrame, DataFrame]:
    rows = d.facts.filter(F.col("concept").isin("LongTermDebt", "CashAndEquivalents"))
    return tuple(rows.filter(F.col("concept") == c).select("ticker", "end", F.col("value").alias(name))
                 for c, name in (("LongTermDebt", "debt"), ("CashAndEquivalents", "cash")))


@query
def frame_sum_difference(d: Data) -> DataFrame:
    debt, cash = _two_frames(d)
    total = ratios.sum_of_frames(debt, cash, "debt", "cash", "total")
    net = ratios.difference_of_frames(debt, cash, "debt", "cash", "net")
    return total.join(net, ["ticker", "end"])


@query
def appended_concept(d: Data) -> DataFrame:
    debt, cash = _two_frames(d)
    net = ratios.difference_of_frames(debt, cash, "debt", "cash", "net")
    return reshape.add_as_concept(d.facts.filter(F.col("concept") == "Goodwill"), net, "net", "NetDebt")


@query
def mean_pivot(d: Data) -> DataFrame:
    return reshape.pivot_mean(d.facts, ["Revenue", "Goodwill"])


@query
def first_rows(d: Data) -> DataFrame:
    return reshape.keep_one(d.facts, ["ticker", "concept"], ["end"])


@query
def duplicate_warning(d: Data) -> DataFrame:
    facts = d.facts
    return reshape.duplicate_warning(facts.unionByName(facts.filter(F.col("concept") == "Goodwill")))


# --- prices, periods, valuation ---------------------------------------------

def _ends(d: Data) -> DataFrame:
    return d.facts.select("ticker", "end").distinct()


@query
def asof_price_backward(d: Data) -> DataFrame:
    return asof.last_price(_ends(d), d.prices)


@query
def asof_price_tolerance(d: Data) -> DataFrame:
    return asof.market_price(_ends(d), d.prices)


@query
def price_as_of(d: Data) -> DataFrame:
    return ts.price_as_of(d.prices, CUTOFF)


@query
def split_events(d: Data) -> DataFrame:
    return prices.split_events(d.prices)


@query
def canonical_ends(d: Data) -> DataFrame:
    return periods.canonical_period_ends(
        T.shifted_facts(d.facts),
        ["Revenue", "StockholdersEquity", "Goodwill", "LongTermDebt", "Capex"])


@query
def dup_period_merge(d: Data) -> DataFrame:
    facts = d.facts
    twins = facts.filter(F.col("value") % 5 == 0).select(
        "ticker", "concept", F.date_add("end", 3).alias("end"), (F.col("value") + 1).alias("value"))
    return periods.merge_duplicate_ends(T.shifted_facts(facts).unionByName(twins))


@query
def valuation_history(d: Data) -> DataFrame:
    return rounded(d.history, "value")


@query
def rolling_harmonic_5y(d: Data) -> DataFrame:
    averages = valuation.five_year_averages(valuation.harmonic_rows(d.valued))
    return rounded(averages, "mean", "mean_median")


@query
def peer_band(d: Data) -> DataFrame:
    valued = cut_lineage(d.valued)
    return valuation.peer_band_flags(valuation.harmonic_rows(valued), d.profiles, AS_OF)


@query
def profile_medians(d: Data) -> DataFrame:
    rows = cut_lineage(visibility.with_profile(d.history, d.profiles))
    keys = ["profile", "concept"]
    middle = group_median(rows, keys, "value").join(
        group_upper_median(rows, keys, "value", "upper_median"), keys)
    return rounded(middle, "median", "upper_median")


# --- snapshot and freshness -------------------------------------------------

def _current(d: Data) -> DataFrame:
    wide = d.shared_wide
    rows = valuation.harmonic_rows(cut_lineage(valuation.valuation_wide(wide, d.quotes)))
    return snapshot.build_snapshot(
        wide, d.quotes, valuation.five_year_averages(rows), AS_OF,
        valuation.peer_band_flags(rows, d.profiles, AS_OF))


@query
def snapshot_latest(d: Data) -> DataFrame:
    return rounded(_current(d), "value")


@query
def snapshot_as_of(d: Data) -> DataFrame:
    wide = d.shared_wide
    averages = valuation.five_year_averages(
        valuation.harmonic_rows(valuation.valuation_wide(wide, d.quotes)))
    return rounded(snapshot.build_snapshot_as_of(CUTOFF, wide, d.prices, averages), "value")


@query
def snapshots_as_of(d: Data) -> DataFrame:
    """A list of dates in one pass."""
    wide = d.shared_wide
    averages = valuation.five_year_averages(
        valuation.harmonic_rows(valuation.valuation_wide(wide, d.quotes)))
    return rounded(snapshot.build_snapshots_as_of(CUTOFFS, wide, d.prices, averages), "value")


@query
def snapshot_points(d: Data) -> DataFrame:
    return rounded(views.snapshot_points(_current(d), AS_OF), "value")


@query
def price_summary(d: Data) -> DataFrame:
    return reshape.price_summary(rounded(_current(d), "value"))


@query
def staleness(d: Data) -> DataFrame:
    return freshness.staleness(d.facts, d.submissions, AS_OF)


@query
def filing_cadence(d: Data) -> DataFrame:
    return freshness.filing_cadence(d.submissions)


@query
def filing_overdue(d: Data) -> DataFrame:
    return freshness.filing_overdue(d.facts, d.submissions, AS_OF)


# --- filing facts -----------------------------------------------------------

@query
def unit_choice(d: Data) -> DataFrame:
    return filing_periods.preferred_units(d.raw)


@query
def latest_filed_dedup(d: Data) -> DataFrame:
    facts = filing_periods.of_period(d.readable, "quarterly", False)
    return filing_periods.latest_filed_durations(facts).select(
        "ticker", "tag", "end", "days", "value", "filed")


@query
def instant_dedup(d: Data) -> DataFrame:
    return filing_periods.tag_series(d.readable, "quarterly", True)


@query
def q4_derive(d: Data) -> DataFrame:
    return filing_periods.tag_series(d.readable, "quarterly", False)


@query
def annual_extract(d: Data) -> DataFrame:
    return filing_periods.tag_series(d.readable, "annual", False)


@query
def sources_resolved(d: Data) -> DataFrame:
    return d.sources.filter(F.col("role") == "term").select(
        "ticker", "concept", "source_ix", "tag")


@query
def concept_merge(d: Data) -> DataFrame:
    return tag_merge.concept_series(d.readable, d.sources)


@query
def annual_ttm_gate(d: Data) -> DataFrame:
    return facts_plan.annual_ttm_rows(d.series, d.readable, d.sources).drop("ttm_source")


@query
def cadence(d: Data) -> DataFrame:
    series = d.series
    annual = facts_plan.annual_ttm_rows(series, d.readable, d.sources)
    facts = cut_lineage(series.select("ticker", "concept", "end", "value", F.lit(None).cast("string")
                                      .alias("ttm_source")).unionByName(annual))
    return views.cadence(ts.add_ttm_concepts(facts))


@query
def known_bad_antijoin(d: Data) -> DataFrame:
    raw = d.raw
    return filing_periods.drop_known_bad(raw, T.known_bad_from_filings(raw)).select(
        "ticker", "tag", "end", "filed", "val")


@query
def masks(d: Data) -> DataFrame:
    series = d.series
    masked = series.filter((F.col("concept") == "OperatingCashFlow") & (F.month("end") == 6))
    return tag_merge.drop_masked_periods(tag_merge.drop_negative(series), masked).select(
        "ticker", "concept", "end", "value")


@query
def restatement_pairs(d: Data) -> DataFrame:
    return share_basis.restatements(d.raw)


@query
def split_corroboration(d: Data) -> DataFrame:
    return d.confirmed_splits


@query
def split_basis(d: Data) -> DataFrame:
    return share_basis.apply_split_basis(d.share_counts, d.confirmed_splits).select(
        "ticker", "end", "value")


def _repaired(d: Data) -> DataFrame:
    return facts_plan.repair_share_counts(
        d.share_counts, d.raw, d.sources, prices.split_events(d.prices)).select(
        "ticker", "concept", "end", "value")


QUERIES["scale_repair"] = _repaired


@query
def shares_basis(d: Data) -> DataFrame:
    return tag_merge.shares_basis(d.readable, d.sources)


@query
def refresh_gate(d: Data) -> DataFrame:
    key = F.substring("ticker", 2, 20).cast("int")
    raw = d.raw.filter(F.col("end") <= F.date_add(F.lit("2001-06-30").cast("date"), key % 3 * 100))
    tried = d.quotes.filter(key % 5 == 0).select(
        "ticker", F.lit(AS_OF).cast("date").alias("last_attempt"))
    return freshness.companies_to_refresh(raw, d.submissions, tried, AS_OF)


@query
def tag_search(d: Data) -> DataFrame:
    return filings.search_tags(d.raw, ["LongTermDebt", "revenue"])


def _identifiers(d: Data) -> tuple[DataFrame, DataFrame]:
    suppliers = d.table("supplier").select(T.ticker_of("s_suppkey").alias("ticker"),
                                           F.col("s_suppkey").alias("cik_str"))
    return suppliers.filter("cik_str % 4 <> 0"), suppliers


@query
def identifier_map(d: Data) -> DataFrame:
    entries, suppliers = _identifiers(d)
    overrides = suppliers.filter("cik_str % 6 = 0").select("ticker", F.lit("override").alias("cik"))
    return filings.identifier_map(entries, overrides, min_entries=1)


@query
def override_audit(d: Data) -> DataFrame:
    entries, suppliers = _identifiers(d)
    shift = F.when(F.col("cik_str") % 3 == 0, 0).otherwise(1)
    overrides = suppliers.select(
        "ticker", F.lpad((F.col("cik_str") + shift).cast("string"), 10, "0").alias("cik"))
    return filings.override_audit(entries, overrides)


@query
def filings_ingested(d: Data) -> DataFrame:
    """Nested company documents, as text, back to flat facts; broken documents are set aside."""
    sound, _ = filings.parsed_documents(T.documents_from_filings(d.raw))
    return filings.flatten_company_facts(sound)


@query
def documents_set_aside(d: Data) -> DataFrame:
    _, broken = filings.parsed_documents(T.documents_from_filings(d.raw))
    return broken.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_documents"))


def _share_series(d: Data) -> DataFrame:
    return facts_plan.on_split_basis(d.share_counts, d.raw, d.sources, prices.split_events(d.prices))


@query
def scale_sweep(d: Data) -> DataFrame:
    return scale_repair.propose_scale(_share_series(d)).select("ticker", "end", "value", "swept")


@query
def scale_evidence(d: Data) -> DataFrame:
    suspects = cut_lineage(scale_repair.proposals(scale_repair.propose_scale(_share_series(d))))
    evidence = facts_plan.share_evidence(d.raw, d.sources)(suspects)
    return scale_repair.verdicts(suspects, *evidence).withColumn("factor", F.round("factor", 3))


@query
def directional_repair(d: Data) -> DataFrame:
    evidence_for = facts_plan.share_evidence(d.raw, d.sources)
    series = cut_lineage(scale_repair.corroborated_scale(_share_series(d), evidence_for))
    return scale_repair.decisions(series, evidence_for).select("ticker", "end", "power", "action")


#: company layers of merge_modes, by a company's number mod 4; layer3 overrides nothing
LAYERS = {
    "layer0": {"Revenue": {"mode": "sum", "point_in_time": False, "tags": [
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"]}},
    "layer1": {"DepreciationAndAmortization": {
        "mode": "fallback_then_sum", "point_in_time": False, "tags": ["DepreciationDepletionAndAmortization"],
        "sum_tags": ["Depreciation", "AmortizationOfIntangibleAssets"]}},
    "layer2": {
        "DepreciationAndAmortization": {
            "mode": "fallback_sum", "point_in_time": False, "tags": ["DepreciationDepletionAndAmortization"],
            "fallback_sum_tags": ["Depreciation", "AmortizationOfIntangibleAssets"]},
        "LongTermDebt": {"mode": "priority_merge", "point_in_time": True, "non_negative": True, "sources": [
            {"type": "tag", "tag": "LongTermDebt"},
            {"type": "sum", "tags": ["LongTermDebtNoncurrent", "LongTermDebtCurrent", "NotesPayableCurrent"],
             "require": "LongTermDebtNoncurrent"}]}},
}


@query
def merge_modes(d: Data) -> DataFrame:
    """All ways to merge tags, in a layer that companies put over their profile's."""
    layers = C.company_sources_frame(d.spark, {
        owner: {c: C.candidate_from_mapping(cfg) for c, cfg in concepts.items()} for owner, concepts in LAYERS.items()})
    sources = cut_lineage(tag_merge.resolved_sources(
        d.profiles, d.profiles, C.profile_sources_frame(d.spark, R.profile_names()), T.company_layer(d.profiles, layers)))
    wanted = sources.filter(F.col("concept").isin("Revenue", "DepreciationAndAmortization", "LongTermDebt"))
    return tag_merge.concept_series(d.readable, wanted).select("ticker", "concept", "end", "value")


# --- coverage and views -----------------------------------------------------

@query
def coverage_flags(d: Data) -> DataFrame:
    expected = tag_merge.expected_concepts(d.sources, d.profiles, R.excluded_frame(d.spark))
    return coverage.coverage_flags(d.facts, expected)


@query
def hidden_filter(d: Data) -> DataFrame:
    return visibility.drop_hidden(d.metrics, d.profiles, d.hidden)


@query
def visibility_matrix(d: Data) -> DataFrame:
    return views.visibility_matrix(d.profiles, d.hidden)


@query
def outlier_report(d: Data) -> DataFrame:
    rows = ts.trailing_years(d.history, YEARS, AS_OF)
    return rounded(views.outlier_report(rows), "value", "times_median")


@query
def valuation_panels(d: Data) -> DataFrame:
    return rounded(views.valuation_panels(d.history, YEARS, AS_OF, True), "value", "mean_line")


@query
def panel_means(d: Data) -> DataFrame:
    return rounded(views.panel_means(d.history, YEARS, AS_OF), "mean_line")


@query
def fundamentals_panels(d: Data) -> DataFrame:
    return views.fundamentals_panels(d.metrics, YEARS, AS_OF)


@query
def growth_panels(d: Data) -> DataFrame:
    return views.growth_panels(ts.add_growth_column(d.full), YEARS, AS_OF)


@query
def comparison(d: Data) -> DataFrame:
    return views.comparison_counts(d.history, d.profiles, d.hidden, YEARS, AS_OF)


@query
def comparison_requests(d: Data) -> DataFrame:
    """Requests that name the companies of a group, and one concept each."""
    key = F.substring("ticker", 2, 20).cast("long")
    concepts = F.array(F.lit("pe_ratio"), F.lit("p_tbv"), F.lit("ev_ebitda"))
    requests = d.profiles.select("ticker", F.explode(concepts).alias("concept")).select(
        F.concat("concept", F.lit("-"), F.when(key == 1, "alone").otherwise((key % 7).cast("string"))).alias("request"),
        "concept", "ticker")
    return views.compare_requests(d.history, requests, d.profiles, d.hidden, YEARS, AS_OF)


@query
def raw_fact_series(d: Data) -> DataFrame:
    return views.raw_fact_series(d.facts, YEARS, AS_OF)


@query
def flag_summary(d: Data) -> DataFrame:
    return views.flag_summary(d.metrics)


@query
def empty_panels(d: Data) -> DataFrame:
    panels = views.visible_panels(d.profiles, d.profiles, d.hidden, R.VALUATION)
    return views.empty_panels(panels, d.history, YEARS, AS_OF)


@query
def share_history_absent(d: Data) -> DataFrame:
    return views.share_history_absent(d.facts)


@query
def null_columns(d: Data) -> DataFrame:
    return views.null_columns(metrics.metrics_long(d.shared_wide), 4)


@query
def available_concepts(d: Data) -> DataFrame:
    return views.available_concepts(d.facts)


@query
def concept_order(d: Data) -> DataFrame:
    return views.concept_order(d.full, d.sources)


@query
def routed_values(d: Data) -> DataFrame:
    wide = d.shared_wide
    history = valuation.valuation_history(valuation.valuation_wide(wide, d.quotes))
    return rounded(views.routed_values(
        metrics.metrics_long(wide), history, ts.add_growth_column(d.full_of(wide, R.GROWTH_PANELS))), "value")


# --- published run ----------------------------------------------------------

@query
def price_scan(d: Data) -> DataFrame:
    """Landed price files, some of them from before the split column."""
    folder = f"{shared_folder(d.spark)}/prices-{uuid.uuid4().hex}"
    odd = F.substring("ticker", 2, 20).cast("long") % 2 == 1
    rows = d.prices.withColumn("date", F.col("date").cast("timestamp"))
    rows.filter(odd).drop("stock_split").write.parquet(f"{folder}/without")
    rows.filter(~odd).write.parquet(f"{folder}/with")
    return prices.read_price_history(d.spark, f"{folder}/*")


@query
def quotes_landed(d: Data) -> DataFrame:
    return prices.quotes(d.quotes)


@query
def unresolved_tickers(d: Data) -> DataFrame:
    entries, _ = _identifiers(d)
    return filings.unresolved(d.profiles, filings.identifier_map(entries, min_entries=1))


@query
def coverage_report(d: Data) -> DataFrame:
    expected = tag_merge.expected_concepts(d.sources, d.profiles, R.excluded_frame(d.spark))
    return coverage.coverage_report(coverage.coverage_flags(d.facts, expected), d.profiles).drop("hint")


@query
def owner_cash_flow(d: Data) -> DataFrame:
    return reshape.unpivot_states(d.wide_without_prices, ["owner_fcf"])


@query
def published_run(d: Data) -> DataFrame:
    """The frames of a run, published, and read back through the manifest: the universe."""
    profiles, hidden = d.profiles, d.hidden
    result = refresh.calculate(d.facts, d.prices, d.quotes, profiles, AS_OF)
    root = f"{shared_folder(d.spark)}/published-{uuid.uuid4().hex}"
    frames = refresh.written_once(refresh.published_frames(result, profiles, hidden), profiles)
    published.publish(frames, profiles.select("ticker"), root, "run", datetime.fromisoformat(AS_OF))
    return published.read_frame(d.spark, root, "run", "universe")


@query
def universe_manifest(d: Data) -> DataFrame:
    profiles, hidden, wide = d.profiles, d.hidden, d.shared_wide
    visible = lambda df: visibility.drop_hidden(df, profiles, hidden)
    growth = published.growth_export(ts.add_growth_column(visible(d.full_of(wide, R.GROWTH_PANELS))))
    history = valuation.valuation_history(valuation.valuation_wide(wide, d.quotes))
    return published.universe(
        visible(metrics.metrics_long(wide)), visible(history), growth, profiles)


@query
def tickers_without_data(d: Data) -> DataFrame:
    requested = d.sparse.select("ticker").unionByName(d.facts.select("ticker"))
    return published.without_data(requested, d.facts.select("ticker").distinct())


# --- the nightly job ---------------------------------------------------------

def _nightly_facts(d: Data) -> DataFrame:
    masked = cut_lineage(d.series_of("OperatingCashFlow").filter(F.month("end") == 6))
    return facts_plan.build_facts(d.raw, d.sources, prices.split_events(d.prices),
                                  T.known_bad_from_filings(d.raw), masked)


@query
def nightly_facts(d: Data) -> DataFrame:
    return _nightly_facts(d).select("ticker", "concept", "end", "value", "ttm_source")


@query
def nightly_snapshot(d: Data) -> DataFrame:
    result = refresh.calculate(cut_lineage(_nightly_facts(d)), d.prices, d.quotes, d.profiles, AS_OF,
                               tag_merge.shares_basis(d.readable, d.sources), d.submissions)
    return refresh.published_frames(result, d.profiles, d.hidden)["current_snapshot"]


def entry(spark: SparkSession) -> DataFrame:
    """Trailing-year revenue and its growth per company."""
    return revenue_ttm_growth(Data(spark, SMOKE_DIR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str, build: Callable[[Data], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Data(spark, sf_dir, name in ABOUT_GAPS))

    return {name: bind(name, build) for name, build in QUERIES.items()} | (
        llm_queries.QUERIES if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    from oracle.statements import oracle_sql as statements
    available = statements()
    return {name: available[name] for name in QUERIES if name in available} | (
        llm_queries.SQL if llm_queries else {})
