"""How old the data is, and whether a filing is overdue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.operators.reshape import unpivot_values


def newest_ends(facts: DataFrame) -> DataFrame:
    return facts.groupBy("ticker").agg(F.max("end").alias("newest_end"))


def latest_filed_periods(submissions: DataFrame) -> DataFrame:
    """Newest period a periodic report was filed for."""
    return (submissions.filter(F.col("form").isin(*K.PERIODIC_FORMS)
                               & F.col("report_date").isNotNull())
            .groupBy("ticker").agg(F.max("report_date").alias("published")))


def newest_reported_periods(raw_facts: DataFrame) -> DataFrame:
    """Newest period end among facts of periodic reports."""
    return (raw_facts.filter(F.col("form").isin(*K.PERIODIC_FORMS))
            .groupBy("ticker").agg(F.max("end").alias("reported")))


def companies_to_refresh(raw_facts: DataFrame, submissions: DataFrame,
                         attempts: DataFrame, today) -> DataFrame:
    """Companies whose filings moved on and that were not tried today.

    ``attempts(ticker, last_attempt)`` is the log of earlier refreshes.
    """
    state = (newest_reported_periods(raw_facts)
             .join(latest_filed_periods(submissions), "ticker")
             .join(attempts.groupBy("ticker").agg(F.max("last_attempt").alias("last_attempt")),
                   "ticker", "left"))
    tried = F.coalesce(F.col("last_attempt") == F.lit(today).cast("date"), F.lit(False))
    return state.filter((F.col("published") > F.col("reported")) & ~tried).select(
        "ticker", "reported", "published")


def staleness(facts: DataFrame, submissions: DataFrame | None, as_of) -> DataFrame:
    """Days since the newest period and whether the fundamentals count as stale."""
    anchor = F.lit(as_of).cast("date")
    rows = newest_ends(facts).withColumn(
        "days_since_last_filing", F.datediff(anchor, "newest_end"))
    by_age = F.col("days_since_last_filing") > K.STALE_AFTER_DAYS
    if submissions is None:
        stale = by_age
    else:
        rows = rows.join(latest_filed_periods(submissions), "ticker", "left")
        stale = F.when(F.col("published").isNotNull(),
                       F.col("published") > F.col("newest_end")).otherwise(by_age)
    rows = rows.withColumn("fundamentals_stale", stale.cast("double"))
    long = unpivot_values(rows, ["days_since_last_filing", "fundamentals_stale"], ("ticker",))
    return long.select("ticker", anchor.alias("end"), "concept", "value")


def filing_cadence(submissions: DataFrame) -> DataFrame:
    """Median filing lag per form and the fiscal-year-end month of every company.

    Lags are whole days below 200 and months are twelve, so counting them first leaves a
    bounded number of rows per company, whatever the number of filings.  The most frequent
    month wins, the smaller one on a tie.
    """
    lag = F.datediff("filing_date", "report_date")
    filings = submissions.filter(F.col("form").isin(*K.PERIODIC_FORMS)).select(
        "ticker", "form", lag.alias("lag"), F.month("report_date").alias("month"))
    counted = (filings.filter((F.col("lag") > 0) & (F.col("lag") < K.FILING_LAG_LIMIT_DAYS))
               .groupBy("ticker", "form", "lag", "month").agg(F.count(F.lit(1)).alias("n")))
    per_month = (counted.filter(F.col("form") == "10-K").groupBy("ticker", "month")
                 .agg(F.sum("n").alias("n")))
    year_end = per_month.groupBy("ticker").agg(
        F.max_by("month", F.col("n") * 100 - F.col("month")).alias("fy_end_month"))
    lags = counted.groupBy("ticker").agg(*[
        F.expr(f"percentile(CASE WHEN form = '{form}' THEN lag END, 0.5, "
               f"CASE WHEN form = '{form}' THEN n ELSE 0 END) AS `{name}`")
        for form, name in (("10-Q", "lag_10q"), ("10-K", "lag_10k"))])
    return lags.join(year_end, "ticker", "left")


def filing_overdue(facts: DataFrame, submissions: DataFrame, as_of) -> DataFrame:
    """Whether the next periodic report should have arrived by ``as_of``."""
    anchor = F.lit(as_of).cast("date")
    rows = (newest_ends(facts).join(filing_cadence(submissions), "ticker")
            .join(latest_filed_periods(submissions), "ticker", "left")
            .withColumn("next_end", F.date_add("newest_end", K.QUARTER_SPACING_DAYS)))
    yearly = F.coalesce(F.month("next_end") == F.col("fy_end_month"), F.lit(False))
    lag = F.when(yearly, F.coalesce("lag_10k", "lag_10q")).otherwise(
        F.coalesce("lag_10q", "lag_10k"))
    # a median lag can end in half a day: compare on the day scale, round late days down
    late = F.datediff(anchor, "next_end") - (lag + K.FILING_BUFFER_DAYS)
    published = F.coalesce(F.col("published") >= F.col("next_end"), F.lit(False))
    rows = rows.withColumns({
        "filing_likely_overdue": ((late > 0) & ~published).cast("double"),
        "days_past_expected_filing": F.floor(late).cast("double"),
    })
    long = unpivot_values(
        rows, ["filing_likely_overdue", "days_past_expected_filing"], ("ticker",))
    return long.select("ticker", anchor.alias("end"), "concept", "value")
