"""The questions a viewer asks of the published frames.

Every view covers all companies at once; a caller narrows it with an ordinary filter on
``ticker``, which reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.functions.expr import harmonic_mean, is_true
from quarterdeck.operators.reshape import base_concept, is_quality_flag
from quarterdeck.operators.timeseries import newest_periods, trailing_years
from quarterdeck.operators.visibility import drop_hidden, with_profile
from quarterdeck.registry import (
    FUNDAMENTALS, GROWTH, GROWTH_PANELS, HARMONIC_METRICS, METRICS, QUARTERLY_TWINS, VALUATION,
    profile_names, registry_frame,
)

SERIES = ["ticker", "concept"]


def visible_panels(companies: DataFrame, profiles: DataFrame, hidden: DataFrame,
                   chart: str | None = None, requested: Sequence[str] | None = None) -> DataFrame:
    """Registered panels each company shows, in registry order.

    A request narrows what is visible; it never brings back a hidden panel.
    """
    menu = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m.id).alias("id"),
                 F.lit(m.chart).alias("chart"), F.lit(m.label).alias("label"))
        for i, m in enumerate(METRICS)
        if (chart is None or m.chart == chart) and (requested is None or m.id in set(requested))])
    per_company = companies.select("ticker").distinct().select("ticker", F.inline(menu))
    shown = drop_hidden(per_company.withColumnRenamed("id", "concept"), profiles, hidden)
    return shown.select("ticker", "position", "concept", "chart", "label")


def outlier_mask(series: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``is_outlier`` (and the series median): far above the series' own median.

    Each series is judged alone and only when it has enough points and a positive median.
    A series has at most one row per day.
    """
    whole = Window.partitionBy(*SERIES)
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    out = series.withColumns({"median": F.percentile(finite, 0.5).over(whole),
                              "_n": F.count(finite).over(whole)})
    fires = ((F.col("_n") >= K.OUTLIER_MIN_POINTS) & (F.col("median") > 0)
             & (finite / F.col("median") > K.OUTLIER_MEDIAN_RATIO))
    return out.withColumn("is_outlier", is_true(fires)).drop("_n")


def outlier_report(series: DataFrame, value: str = "value") -> DataFrame:
    """The rows a masked panel would leave out, with their multiple of the median."""
    return outlier_mask(series, value).filter("is_outlier").select(
        *SERIES, "end", value, (F.col(value) / F.col("median")).alias("times_median"))


def valuation_panels(history: DataFrame, years: int, as_of, mask_outliers: bool = False) -> DataFrame:
    """Panel series with their mean line; the mean always covers the unmasked series."""
    window = trailing_years(history, years, as_of)
    whole = Window.partitionBy(*SERIES)
    harmonic = F.col("concept").isin(*HARMONIC_METRICS)
    usable = F.when(F.col("value") > 0, F.col("value"))
    harmonic_line = F.try_divide(F.count(usable).over(whole).cast("double"),
                                 F.sum(F.lit(1.0) / usable).over(whole))
    panels = window.withColumn(
        "mean_line", F.when(harmonic, harmonic_line).otherwise(F.avg("value").over(whole)))
    if mask_outliers:
        panels = outlier_mask(panels).filter(~F.col("is_outlier")).drop("is_outlier", "median")
    return panels.select("ticker", "concept", "end", "value", "mean_line")


def panel_means(history: DataFrame, years: int, as_of) -> DataFrame:
    """One mean line per panel."""
    harmonic = F.col("concept").isin(*HARMONIC_METRICS)
    rows = trailing_years(history, years, as_of)
    out = rows.groupBy(*SERIES).agg(
        F.count("value").alias("n"), harmonic_mean(F.col("value")).alias("_harmonic"),
        F.avg("value").alias("_plain"))
    return out.select(*SERIES, "n", F.when(harmonic, F.col("_harmonic"))
                      .otherwise(F.col("_plain")).alias("mean_line"))


def snapshot_points(snapshot: DataFrame, as_of=None) -> DataFrame:
    """Newest snapshot value per panel, unless the view's date lies before it."""
    known = snapshot.filter(F.col("end").isNotNull() & F.col("value").isNotNull())
    out = known.groupBy(*SERIES).agg(F.max_by("value", "end").alias("value"),
                                     F.max("end").alias("end"))
    if as_of is not None:
        out = out.filter(F.col("end") <= F.lit(as_of).cast("date"))
    return out.select("ticker", "concept", "end", "value")


def fundamentals_panels(metrics: DataFrame, years: int, as_of) -> DataFrame:
    """Trailing-year series with its quarterly twin beside it.

    A twin appears only behind a trailing-year series that has data.
    """
    window = trailing_years(metrics, years, as_of, close_at_anchor=False)
    base = F.coalesce(*[F.when(F.col("concept") == twin, F.lit(m))
                        for m, twin in QUARTERLY_TWINS.items()], F.col("concept"))
    tagged = window.withColumns({"panel": base, "_twin": base != F.col("concept")})
    rows = tagged.groupBy("ticker", "panel", "end").agg(
        F.max(F.when(~F.col("_twin"), F.col("value"))).alias("value"),
        F.max(F.when(F.col("_twin"), F.col("value"))).alias("quarterly_value"))
    panel = Window.partitionBy("ticker", "panel")
    return (rows.withColumn("_n", F.count("value").over(panel)).filter("_n > 0")
            .select("ticker", F.col("panel").alias("concept"), "end", "value", "quarterly_value"))


def growth_panels(facts: DataFrame, years: int, as_of) -> DataFrame:
    """Growth series of the registered growth concepts that have any value."""
    window = trailing_years(facts.filter(F.col("concept").isin(*GROWTH_PANELS)), years, as_of,
                            close_at_anchor=False)
    n = F.count("yoy_growth").over(Window.partitionBy(*SERIES))
    return (window.withColumn("_n", n).filter("_n > 0")
            .select("ticker", "concept", "end", "yoy_growth"))


def compare(data: DataFrame, concept: str, tickers: Sequence[str], profiles: DataFrame,
            hidden: DataFrame, years: int, as_of, value: str = "value"
            ) -> tuple[DataFrame, DataFrame]:
    """``(series, excluded)`` of one concept for several companies.

    Hidden or empty companies are left out with a reason.  Only valuation concepts carry an
    outlier mark, judged per line.
    """
    wanted = list(dict.fromkeys(tickers))
    if len(wanted) < K.COMPARISON_MIN_TICKERS:
        raise ValueError(f"a comparison needs {K.COMPARISON_MIN_TICKERS} distinct companies")
    spark = data.sparkSession
    asked = with_profile(
        spark.createDataFrame([(t,) for t in wanted], "ticker string"), profiles)
    is_hidden = (hidden.filter(F.col("concept") == concept).select("profile").distinct()
                 .withColumn("_hidden", F.lit(True)))
    asked = asked.join(is_hidden, "profile", "left")
    rows = trailing_years(
        data.filter((F.col("concept") == concept) & F.col("ticker").isin(*wanted)), years, as_of)
    counts = rows.groupBy("ticker").agg(F.count(value).alias("_n"))
    judged = asked.join(counts, "ticker", "left").withColumn(
        "reason", F.when(F.col("_hidden"), F.concat(
            F.lit("for profile '"), F.col("profile"), F.lit("' not shown")))
        .when(F.coalesce("_n", F.lit(0)) == 0, "No Data"))
    plotted = rows.join(judged.filter(F.col("reason").isNull()).select("ticker"), "ticker",
                        "left_semi")
    series = outlier_mask(plotted, value).select(*SERIES, "end", value, "is_outlier")
    if not any(m.id == concept and m.chart == VALUATION for m in METRICS):
        series = series.withColumn("is_outlier", F.lit(False))
    return series, judged.filter(F.col("reason").isNotNull()).select("ticker", "reason")


def comparison_counts(data: DataFrame, profiles: DataFrame, hidden: DataFrame, years: int,
                      as_of) -> DataFrame:
    """For every company and concept: shown or why not, with points and outliers."""
    rows = outlier_mask(trailing_years(data, years, as_of))
    counted = with_profile(rows.groupBy(*SERIES).agg(
        F.count("value").alias("n_points"), F.count_if("is_outlier").alias("n_outliers")), profiles)
    marked = counted.join(hidden.withColumn("_hidden", F.lit(True)), ["profile", "concept"], "left")
    return marked.select(
        *SERIES, "n_points", "n_outliers",
        F.when(F.col("_hidden"), "hidden").when(F.col("n_points") == 0, "no data")
        .otherwise("shown").alias("status"))


def compare_requests(data: DataFrame, requests: DataFrame, profiles: DataFrame, hidden: DataFrame,
                     years: int, as_of) -> DataFrame:
    """``requests(request, concept, ticker)`` with what each shows: n_points, n_outliers, reason.

    All requests are answered together: series are judged once, however many requests name them.
    A request of fewer than two companies, a hidden concept and a series without values are
    left out with a reason.
    """
    asked = with_profile(requests.select("request", "concept", "ticker").distinct(), profiles)
    of_request = Window.partitionBy("request", "concept")
    asked = asked.withColumn("_companies", F.count(F.lit(1)).over(of_request))
    valued = F.array(*[F.lit(m.id) for m in METRICS if m.chart == VALUATION])
    named = asked.select(*SERIES).distinct()
    rows = outlier_mask(trailing_years(data.join(named, SERIES, "left_semi"), years, as_of))
    counted = rows.groupBy(*SERIES).agg(
        F.count("value").alias("n_points"),
        F.count_if(F.col("is_outlier") & F.array_contains(valued, F.col("concept"))).alias("n_outliers"))
    marks = hidden.select("profile", "concept", F.lit(True).alias("_hidden")).distinct()
    found = asked.join(counted, SERIES, "left").join(marks, ["profile", "concept"], "left")
    n = F.coalesce("n_points", F.lit(0))
    reason = (F.when(F.col("_companies") < K.COMPARISON_MIN_TICKERS, "too few companies")
              .when(F.col("_hidden"), F.concat(F.lit("for profile '"), F.col("profile"), F.lit("' not shown")))
              .when(n == 0, "No Data"))
    return found.select("request", *SERIES, n.alias("n_points"),
                        F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"), reason.alias("reason"))


def available_concepts(facts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Concepts with at least one value; only fetched ones when ``sources`` is given."""
    known = facts.filter(F.col("value").isNotNull()).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_values"))
    if sources is None:
        return known
    return known.join(sources.select(*SERIES).distinct(), SERIES, "left_semi")


def raw_fact_series(facts: DataFrame, years: int, as_of, sources: DataFrame | None = None) -> DataFrame:
    shown = available_concepts(facts, sources).select(*SERIES)
    rows = trailing_years(facts, years, as_of, close_at_anchor=False)
    return rows.join(shown, SERIES, "left_semi").select(*SERIES, "end", "value")


def concept_order(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Concepts of a company grouped by base name, fetched before derived."""
    fetched = sources.select(*SERIES).distinct().withColumn("_fetched", F.lit(True))
    listed = facts.select(*SERIES).distinct().join(fetched, SERIES, "left").select(
        *SERIES, base_concept("concept").alias("base"),
        F.col("_fetched").isNull().alias("derived"))
    place = Window.partitionBy("ticker").orderBy("base", "derived", "concept")
    return listed.withColumn("position", F.row_number().over(place))


def cadence(facts: DataFrame) -> DataFrame:
    """How the trailing-year values of a series were obtained, where it is worth a mark."""
    sources = (facts.filter(F.col("ttm_source").isNotNull()).groupBy(*SERIES)
               .agg(F.array_sort(F.collect_set("ttm_source")).alias("sources")))
    mark = (F.when(F.size("sources") > 1, "mixed")
            .when(F.col("sources")[0] == K.TTM_ANNUAL, "annual"))
    return sources.withColumn("cadence", mark).filter("cadence IS NOT NULL").select(
        *SERIES, "cadence")


def flag_summary(metrics: DataFrame) -> DataFrame:
    """Per flag: times raised, periods evaluated, most recent raise."""
    raised = F.col("value") == 1.0
    return metrics.filter(is_quality_flag(F.col("concept"))).groupBy(*SERIES).agg(
        F.count_if(raised).alias("raised"), F.count("value").alias("periods_evaluated"),
        F.max(F.when(raised, F.col("end"))).alias("most_recent"))


def empty_panels(panels: DataFrame, history: DataFrame, years: int, as_of) -> DataFrame:
    """Requested ``(ticker, concept)`` panels without any value in the window."""
    filled = trailing_years(history, years, as_of).filter(F.col("value").isNotNull())
    return panels.select(*SERIES).join(filled.select(*SERIES).distinct(), SERIES, "left_anti")


def share_history_absent(facts: DataFrame) -> DataFrame:
    """Companies without a single share-count value."""
    shares = F.when(F.col("concept") == "SharesOutstanding", F.col("value"))
    return (facts.groupBy("ticker").agg(F.count(shares).alias("_n")).filter("_n = 0")
            .select("ticker"))


def null_columns(frame: DataFrame, periods: int = 16) -> DataFrame:
    """Number of concepts that are null in every shown period, per company."""
    concepts = frame.select(*SERIES).distinct()
    shown = newest_periods(frame, periods).groupBy(*SERIES).agg(F.count("value").alias("_n"))
    return (concepts.join(shown, SERIES, "left").groupBy("ticker")
            .agg(F.count_if(F.coalesce("_n", F.lit(0)) == 0).alias("null_concepts"),
                 F.count(F.lit(1)).alias("concepts")))


def visibility_matrix(profiles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Company x metric: is it shown for the company's profile?"""
    menu = F.array(*[F.struct(F.lit(m.id).alias("id"), F.lit(m.chart).alias("chart")) for m in METRICS])
    asked = profiles.select("ticker", "profile", F.inline(menu))
    marks = hidden.select("profile", F.col("concept").alias("id"), F.lit(True).alias("_hidden")).distinct()
    return asked.join(marks, ["profile", "id"], "left").select(
        "ticker", "id", "chart", F.col("_hidden").isNull().alias("shown"))


def undocumented_metrics(spark) -> DataFrame:
    return registry_frame(spark).filter(~F.col("documented")).select("position", "id")


def routed_values(metrics: DataFrame, history: DataFrame, facts: DataFrame) -> DataFrame:
    """All chartable values in one frame, each concept from the frame its chart reads."""
    charts = F.broadcast(registry_frame(metrics.sparkSession).select(
        F.col("id").alias("concept"), "chart"))
    frames = ((metrics, "value", FUNDAMENTALS), (history, "value", VALUATION),
              (facts, "yoy_growth", GROWTH))
    out = None
    for frame, column, chart in frames:
        part = frame.select("ticker", "concept", "end", F.col(column).alias("value")).join(
            charts.filter(F.col("chart") == chart), "concept")
        out = part if out is None else out.unionByName(part)
    return out.select("ticker", "chart", "concept", "end", "value")
