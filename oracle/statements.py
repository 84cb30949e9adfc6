"""One DuckDB statement per registered query."""

from __future__ import annotations

from quarterdeck import constants as K
from quarterdeck import registry as R
from oracle.common import (
    AS_OF, CTES, CUTOFF, canonical_of, growth_of, ratio, guarded_ratio, rounded, self_guarded,
    statement, ttm_of,
)
from oracle import filings  # noqa: F401  (adds its common table expressions)
from oracle.snapshot import SNAPSHOT_AS_OF, SNAPSHOT_LATEST, SNAPSHOTS_AS_OF

LOOSE = "CASE WHEN concept IN ({}) THEN 0.05 ELSE 0.33 END".format(
    ", ".join(f"'{c}'" for c in K.GROWTH_LOOSE_BASE_CONCEPTS))
EXCLUDED = ", ".join(f"'{n}'" for c in K.GROWTH_EXCLUDED_CONCEPTS for n in (c, f"{c}_TTM"))
TWINS = " ".join(f"WHEN '{t}' THEN '{m}'" for m, t in R.QUARTERLY_TWINS.items())
HARMONIC = ", ".join(f"'{c}'" for c in R.HARMONIC_METRICS)
GROWTH_PANELS = ", ".join(f"'{c}'" for c in R.GROWTH_PANELS)
END = 'pe AS "end"'

CTES["shifted"] = """
SELECT ticker, concept, unnest(CASE WHEN (k + length(concept)) % 5 = 0 THEN [moved, pe - 28] ELSE [moved] END) AS pe,
  value FROM (SELECT *, CASE WHEN k % 3 = 0 THEN pe - CAST(length(concept) % 8 AS INTEGER) ELSE pe END AS moved
              FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS k FROM f1))"""
CTES["vis"] = """
SELECT m.* FROM metrics m LEFT JOIN profiles p USING (ticker)
WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.profile = coalesce(p.profile, 'standard')
                  AND h.concept = m.concept)"""
CTES["vhvis"] = CTES["vis"].replace("metrics m", "vh m")
CTES["win"] = f"SELECT * FROM vh WHERE pe >= DATE '{AS_OF}' - INTERVAL 5 YEAR AND pe <= DATE '{AS_OF}'"
CTES["marked"] = """
SELECT w.*, s.med, coalesce(s.n >= 8 AND s.med > 0 AND w.value / s.med > 5, false) AS is_outlier
FROM win w JOIN (SELECT ticker, concept, median(value) AS med, count(value) AS n FROM win GROUP BY ALL) s
  USING (ticker, concept)"""
CTES["factsgrown"] = f"""
SELECT ticker, concept, pe, value, CASE WHEN concept NOT IN ({EXCLUDED}) THEN growth END AS yoy
FROM ({growth_of('af', LOOSE)})"""
CTES["newest"] = "SELECT ticker, max(pe) AS newest_end FROM f1 GROUP BY ALL"
CTES["filed"] = "SELECT ticker, max(report_date) AS published FROM subs GROUP BY ALL"
CTES["cad"] = """
SELECT ticker, median(lag) FILTER (form = '10-Q') AS q_lag, median(lag) FILTER (form = '10-K') AS k_lag,
  mode(month(report_date)) FILTER (form = '10-K') AS fy
FROM (SELECT *, filing_date - report_date AS lag FROM subs) WHERE lag > 0 AND lag < 200 GROUP BY ALL"""

STATEMENTS = {
    "ttm_quarterly": f"""SELECT ticker, concept, {END}, value FROM ({ttm_of('f1', K.TTM_CONCEPTS)})
UNION ALL SELECT ticker, concept, {END}, value FROM ({ttm_of('f2')})""",
    "growth_yoy": f"""SELECT ticker, concept, {END}, value, yoy AS yoy_growth FROM factsgrown
UNION ALL SELECT ticker, concept, {END}, value, growth FROM ({growth_of('f2')})""",
    "revenue_ttm_growth": f"""SELECT ticker, {END}, value, growth AS yoy_growth FROM (
  {growth_of('af', where="concept = 'Revenue_TTM'")})""",
    "qoq_flags": f"""SELECT ticker, concept, {END}, value FROM buyback
UNION ALL SELECT ticker, concept, {END}, value FROM inorganic""",
    "share_jump_flag": f"SELECT ticker, {END}, value AS share_count_jump_flag FROM jump",
    "ratio_guarded": f"""SELECT ticker, {END}, value AS roe FROM (
  {guarded_ratio('roe', 'NetIncomeLoss_TTM', 'StockholdersEquity', 'Revenue_TTM', 0.01)})""",
    "margin_self_guarded": f"""SELECT ticker, {END}, value AS operating_margin FROM (
  {self_guarded('operating_margin', 'OperatingIncomeLoss_TTM')})""",
    "difference_and_sum": f"""SELECT 'S' || s AS ticker, {END}, CAST(returned * 3 AS DOUBLE) - CAST(accepted + disc AS DOUBLE) AS net_debt,
  CAST(returned * 3 AS DOUBLE) + CAST(accepted + disc AS DOUBLE) AS total FROM sums""",
    "frame_ratio_limits": f"""SELECT ticker, {END}, CASE WHEN abs(d) >= 10000000 AND abs(n / nullif(d, 0)) <= 60
  THEN n / d END AS net_debt_to_ebitda
FROM (SELECT ticker, pe, value AS n FROM m1 WHERE concept = 'net_debt')
JOIN (SELECT ticker, pe, value AS d FROM af WHERE concept = 'EBITDA_TTM') USING (ticker, pe)""",
    "derived_concepts": f"SELECT ticker, concept, {END}, value FROM derived",
    "metrics_long": f"SELECT ticker, concept, {END}, value FROM metrics",
    "scale_reference": f"""SELECT ticker, {END}, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pe ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS scale FROM af WHERE concept = 'Revenue_TTM'""",
    "asof_price_backward": f"""SELECT e.ticker, e.pe AS "end", p.close FROM (SELECT DISTINCT ticker, pe FROM f1) e
ASOF LEFT JOIN px p ON e.ticker = p.ticker AND e.pe >= p.dt""",
    "asof_price_tolerance": f"""SELECT e.ticker, e.pe AS "end", CASE WHEN e.pe - p.dt <= 10 THEN p.close END AS market_price
FROM (SELECT DISTINCT ticker, pe FROM f1) e
ASOF LEFT JOIN (SELECT * FROM px WHERE close IS NOT NULL) p ON e.ticker = p.ticker AND e.pe >= p.dt""",
    "price_as_of": f"""SELECT ticker, close AS price FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS place
FROM px WHERE dt <= DATE '{CUTOFF}') WHERE place = 1""",
    "split_events": "SELECT ticker, dt AS date, stock_split AS ratio FROM px WHERE stock_split <> 0",
    "canonical_ends": 'SELECT ticker, pe AS "end", canonical AS canonical_end FROM ('
                      + canonical_of("shifted", "'Revenue', 'StockholdersEquity', 'Goodwill', 'LongTermDebt', 'Capex'") + ")",
    "dup_period_merge": f"""SELECT ticker, concept, {END}, value FROM (
  SELECT *, lead(pe) OVER (PARTITION BY ticker, concept ORDER BY pe) - pe AS ahead FROM (
    SELECT * FROM shifted UNION ALL SELECT ticker, concept, pe + 3, value + 1 FROM f1 WHERE value % 5 = 0))
WHERE ahead IS NULL OR ahead > 7""",
    "valuation_history": f"SELECT ticker, concept, {END}, {rounded()} AS value FROM vh",
    "rolling_harmonic_5y": f"""SELECT ticker, concept, {END}, {rounded('mean')} AS mean,
  {rounded('med')} AS mean_median, n AS mean_n FROM avg5""",
    "peer_band": "SELECT ticker, concept, value FROM peers",
    "profile_medians": f"""SELECT profile, concept, {rounded('med')} AS median, {rounded('upper')} AS upper_median FROM (
  SELECT coalesce(p.profile, 'standard') AS profile, v.concept, median(v.value) AS med,
    list_sort(list(v.value))[CAST(count(*) // 2 AS INTEGER) + 1] AS upper
  FROM vh v LEFT JOIN profiles p USING (ticker) WHERE v.value IS NOT NULL GROUP BY ALL)""",
    "snapshot_latest": SNAPSHOT_LATEST,
    "snapshot_as_of": SNAPSHOT_AS_OF,
    "snapshots_as_of": SNAPSHOTS_AS_OF,
    "latest_values": f"""SELECT ticker, concept, pe AS "end", value, CAST(newest - pe AS INTEGER) AS value_age_days FROM (
  SELECT *, max(pe) OVER (PARTITION BY ticker, concept) AS newest,
    row_number() OVER (PARTITION BY ticker, concept ORDER BY value IS NULL, pe DESC) AS place FROM f1)
WHERE place = 1 AND value IS NOT NULL AND newest - pe <= 365""",
    "latest_rows": f"""SELECT ticker, concept, {END}, value FROM (SELECT *, row_number() OVER (
  PARTITION BY ticker, concept ORDER BY pe DESC) AS place FROM f1) WHERE place = 1""",
    "staleness": f"""SELECT ticker, DATE '{AS_OF}' AS "end", x.concept AS concept, x.value AS value FROM (
  SELECT ticker, unnest([
    {{'concept': 'days_since_last_filing', 'value': CAST(DATE '{AS_OF}' - newest_end AS DOUBLE)}},
    {{'concept': 'fundamentals_stale', 'value': CAST(coalesce(published > newest_end, DATE '{AS_OF}' - newest_end > 135) AS DOUBLE)}}]) AS x
  FROM newest LEFT JOIN filed USING (ticker))""",
    "filing_cadence": """SELECT ticker, q_lag AS lag_10q, k_lag AS lag_10k, CAST(fy AS INTEGER) AS fy_end_month FROM cad""",
    "filing_overdue": f"""SELECT ticker, DATE '{AS_OF}' AS "end", x.concept AS concept, x.value AS value FROM (
  SELECT ticker, unnest([
    {{'concept': 'filing_likely_overdue', 'value': CAST(late > 0 AND NOT coalesce(published >= next_end, false) AS DOUBLE)}},
    {{'concept': 'days_past_expected_filing', 'value': CAST(floor(late) AS DOUBLE)}}]) AS x
  FROM (SELECT *, (DATE '{AS_OF}' - next_end) - (CASE WHEN month(next_end) = fy THEN coalesce(k_lag, q_lag) ELSE coalesce(q_lag, k_lag) END + 7) AS late
        FROM (SELECT n.ticker, c.*, f.published, n.newest_end + 91 AS next_end FROM newest n
              JOIN cad c ON n.ticker = c.ticker LEFT JOIN filed f ON n.ticker = f.ticker)))""",
    "coverage_flags": f"""SELECT e.ticker, e.concept, e.n AS count, e.best AS max_for_ticker, e.n / CAST(e.best AS DOUBLE) AS ratio FROM (
  SELECT *, max(n) OVER (PARTITION BY ticker) AS best FROM (
    SELECT w.ticker, w.concept, coalesce(f.n, 0) AS n
    FROM (SELECT DISTINCT t.ticker, s.concept FROM profiles t JOIN sources s ON s.profile = t.profile
          WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.profile = t.profile AND x.concept = s.concept)) w
    SEMI JOIN f1 ON w.ticker = f1.ticker
    LEFT JOIN (SELECT ticker, concept, count(*) AS n FROM f1 GROUP BY ALL) f
      ON w.ticker = f.ticker AND w.concept = f.concept)) e
WHERE e.n / CAST(e.best AS DOUBLE) < 0.5""",
    "coverage_report": f"""SELECT p.profile, e.ticker, e.concept, CASE WHEN e.n = 0 THEN 'MISSING' ELSE 'thin' END AS marker,
  e.n AS count, e.best AS max_for_ticker, e.n / CAST(e.best AS DOUBLE) AS ratio FROM (
  SELECT *, max(n) OVER (PARTITION BY ticker) AS best FROM (
    SELECT w.ticker, w.concept, coalesce(f.n, 0) AS n
    FROM (SELECT DISTINCT t.ticker, s.concept FROM profiles t JOIN sources s ON s.profile = t.profile
          WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.profile = t.profile AND x.concept = s.concept)) w
    SEMI JOIN f1 ON w.ticker = f1.ticker
    LEFT JOIN (SELECT ticker, concept, count(*) AS n FROM f1 GROUP BY ALL) f
      ON w.ticker = f.ticker AND w.concept = f.concept)) e JOIN profiles p USING (ticker)
WHERE e.n / CAST(e.best AS DOUBLE) < 0.5""",
    "price_scan": "SELECT ticker, dt AS date, close, stock_split FROM px",
    "quotes_landed": "SELECT ticker, price, shares_outstanding, price * shares_outstanding AS market_cap FROM quotes",
    "unresolved_tickers": "SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 4 = 0",
    "owner_cash_flow": f"""SELECT ticker, 'owner_fcf' AS concept, {END}, a.value - b.value AS value
FROM (SELECT ticker, pe, value FROM af WHERE concept = 'FCF_TTM') a
JOIN (SELECT ticker, pe, value FROM af WHERE concept = 'ShareBasedCompensation_TTM') b USING (ticker, pe)""",
    "raw_fact_series": f"""SELECT ticker, concept, {END}, value FROM f1 WHERE pe >= DATE '{AS_OF}' - INTERVAL 5 YEAR
  AND (ticker, concept) IN (SELECT (ticker, concept) FROM f1 WHERE value IS NOT NULL)""",
    "comparison_requests": """SELECT request, a.ticker, a.concept, coalesce(n_points, 0) AS n_points, coalesce(n_outliers, 0) AS n_outliers,
  CASE WHEN companies < 2 THEN 'too few companies'
    WHEN h.concept IS NOT NULL THEN concat('for profile ', chr(39), a.profile, chr(39), ' not shown')
    WHEN coalesce(n_points, 0) = 0 THEN 'No Data' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY request) AS companies FROM (
  SELECT ticker, profile, concept, concept || '-' || CASE WHEN k = 1 THEN 'alone' ELSE CAST(k % 7 AS VARCHAR) END AS request
  FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS k FROM profiles), (VALUES ('pe_ratio'), ('p_tbv'), ('ev_ebitda')) AS c(concept))) a
LEFT JOIN (SELECT ticker, concept, count(value) AS n_points, count(*) FILTER (is_outlier) AS n_outliers FROM marked GROUP BY ALL) m
  ON m.ticker = a.ticker AND m.concept = a.concept
LEFT JOIN hidden h ON h.profile = a.profile AND h.concept = a.concept""",
    "hidden_filter": f"SELECT ticker, concept, {END}, value FROM vis",
    "visibility_matrix": """SELECT p.ticker, m.id, m.chart,
  NOT EXISTS (SELECT 1 FROM hidden h WHERE h.profile = p.profile AND h.concept = m.id) AS shown
FROM profiles p CROSS JOIN (VALUES {}) AS m(id, chart)""".format(
        ", ".join(f"('{m.id}', '{m.chart}')" for m in R.METRICS)),
    "outlier_report": f"""SELECT ticker, concept, {END}, {rounded()} AS value, {rounded('value / med')} AS times_median
FROM marked WHERE is_outlier""",
    "valuation_panels": f"""SELECT m.ticker, m.concept, m.pe AS "end", {rounded('m.value')} AS value, {rounded('a.line')} AS mean_line
FROM marked m JOIN (SELECT ticker, concept, CASE WHEN concept IN ({HARMONIC})
    THEN count(value) FILTER (value > 0) / nullif(sum(1 / value) FILTER (value > 0), 0) ELSE avg(value) END AS line
  FROM win GROUP BY ticker, concept) a USING (ticker, concept) WHERE NOT m.is_outlier""",
    "panel_means": f"""SELECT ticker, concept, count(value) AS n, {rounded(f'''CASE WHEN concept IN ({HARMONIC})
    THEN count(value) FILTER (value > 0) / nullif(sum(1 / value) FILTER (value > 0), 0) ELSE avg(value) END''')} AS mean_line
FROM win GROUP BY ticker, concept""",
    "fundamentals_panels": f"""SELECT ticker, panel AS concept, {END}, value, quarterly_value FROM (
  SELECT *, count(value) OVER (PARTITION BY ticker, panel) AS n FROM (
    SELECT ticker, CASE concept {TWINS} ELSE concept END AS panel, pe,
      max(value) FILTER (CASE concept {TWINS} ELSE concept END = concept) AS value,
      max(value) FILTER (CASE concept {TWINS} ELSE concept END <> concept) AS quarterly_value
    FROM metrics WHERE pe >= DATE '{AS_OF}' - INTERVAL 5 YEAR GROUP BY ALL)) WHERE n > 0""",
    "growth_panels": f"""SELECT ticker, concept, {END}, yoy AS yoy_growth FROM (
  SELECT *, count(yoy) OVER (PARTITION BY ticker, concept) AS n FROM factsgrown
  WHERE concept IN ({GROWTH_PANELS}) AND pe >= DATE '{AS_OF}' - INTERVAL 5 YEAR) WHERE n > 0""",
    "comparison": """SELECT ticker, concept, count(value) AS n_points, count(*) FILTER (is_outlier) AS n_outliers,
  CASE WHEN bool_or(h.concept IS NOT NULL) THEN 'hidden' WHEN count(value) = 0 THEN 'no data' ELSE 'shown' END AS status
FROM (SELECT m.ticker, m.concept AS concept, m.value, m.is_outlier, coalesce(p.profile, 'standard') AS profile
      FROM marked m LEFT JOIN profiles p USING (ticker)) q
LEFT JOIN hidden h USING (profile, concept) GROUP BY ticker, concept""",
    "flag_summary": """SELECT ticker, concept, count(*) FILTER (value = 1) AS raised, count(value) AS periods_evaluated,
  max(pe) FILTER (value = 1) AS most_recent FROM metrics
WHERE suffix(concept, '_flag') OR concept IN ('fcf_exceeds_ebitda', 'inorganic_contaminated') GROUP BY ALL""",
    "empty_panels": f"""SELECT t.ticker, m.id AS concept FROM (SELECT DISTINCT ticker FROM profiles) t,
  (VALUES {", ".join(f"('{m.id}')" for m in R.METRICS if m.chart == 'valuation')}) AS m(id)
WHERE NOT EXISTS (SELECT 1 FROM profiles p JOIN hidden h ON h.profile = p.profile AND h.concept = m.id WHERE p.ticker = t.ticker)
  AND NOT EXISTS (SELECT 1 FROM win w WHERE w.ticker = t.ticker AND w.concept = m.id AND w.value IS NOT NULL)""",
    "share_history_absent": """SELECT ticker FROM f1 GROUP BY ticker
HAVING count(value) FILTER (concept = 'SharesOutstanding') = 0""",
    "pivot_periods": 'SELECT ticker, {}, {} FROM f1 GROUP BY ticker, pe'.format(END, ", ".join(
        f"max(value) FILTER (concept = '{c}') AS {c}" for c in ("Revenue", "NetIncomeLoss", "Goodwill", "Capex"))),
    "null_columns": """SELECT ticker, count(*) FILTER (n = 0) AS null_concepts, count(*) AS concepts FROM (
  SELECT c.ticker, c.concept, count(s.value) AS n FROM (SELECT DISTINCT ticker, concept FROM metrics) c
  LEFT JOIN (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY pe DESC) AS place FROM metrics) WHERE place <= 4) s
    USING (ticker, concept) GROUP BY ALL) GROUP BY ticker""",
    "available_concepts": "SELECT ticker, concept, count(*) AS n_values FROM f1 WHERE value IS NOT NULL GROUP BY ALL",
    "concept_order": """SELECT ticker, concept, base, derived, row_number() OVER (PARTITION BY ticker ORDER BY base, derived, concept) AS position FROM (
  SELECT DISTINCT a.ticker, a.concept, regexp_replace(a.concept, '(_CALC|_TTM|_QUARTERLY)+$', '') AS base,
    NOT EXISTS (SELECT 1 FROM profiles p JOIN sources s ON s.profile = p.profile WHERE p.ticker = a.ticker AND s.concept = a.concept) AS derived
  FROM af a)""",
    "routed_values": f"""SELECT ticker, chart, concept, {END}, {rounded()} AS value FROM (
  SELECT ticker, 'fundamentals' AS chart, concept, pe, value FROM metrics WHERE concept IN ({", ".join(f"'{m.id}'" for m in R.METRICS if m.chart == 'fundamentals')})
  UNION ALL SELECT ticker, 'valuation', concept, pe, value FROM vh WHERE concept IN ({", ".join(f"'{m.id}'" for m in R.METRICS if m.chart == 'valuation')})
  UNION ALL SELECT ticker, 'growth', concept, pe, yoy FROM factsgrown WHERE concept IN ({GROWTH_PANELS}))""",
    "snapshot_points": f"""SELECT ticker, concept, DATE '{AS_OF}' AS "end", value FROM ({SNAPSHOT_LATEST})""",
    "price_summary": f"""SELECT ticker, max(value) FILTER (concept = 'price') AS price,
  max(value) FILTER (concept = 'shares_outstanding') AS shares_outstanding,
  max(value) FILTER (concept = 'market_cap') AS market_cap FROM ({SNAPSHOT_LATEST})
WHERE concept IN ('price', 'shares_outstanding', 'market_cap') GROUP BY ticker""",
    "universe_manifest": f"""SELECT ticker, coalesce(p.profile, 'standard') AS profile,
  CAST(sum(m) AS BIGINT) AS n_metrics, CAST(sum(v) AS BIGINT) AS n_valuation, CAST(sum(g) AS BIGINT) AS n_growth FROM (
  SELECT ticker, 1 AS m, 0 AS v, 0 AS g FROM vis UNION ALL SELECT ticker, 0, 1, 0 FROM vhvis
  UNION ALL SELECT ticker, 0, 0, 1 FROM factsgrown f WHERE concept IN ({GROWTH_PANELS})
    AND NOT EXISTS (SELECT 1 FROM profiles p JOIN hidden h USING (profile) WHERE p.ticker = f.ticker AND h.concept = f.concept)
) LEFT JOIN profiles p USING (ticker) GROUP BY ALL""",
    "tickers_without_data": """SELECT DISTINCT ticker FROM (SELECT ticker FROM f2 UNION ALL SELECT ticker FROM f1)
WHERE ticker NOT IN (SELECT ticker FROM f1)""",
    "frame_sum_difference": f"""SELECT 'S' || s AS ticker, {END}, CAST(returned * 3 AS DOUBLE) + CAST(accepted + disc AS DOUBLE) AS total,
  CAST(returned * 3 AS DOUBLE) - CAST(accepted + disc AS DOUBLE) AS net FROM sums""",
    "appended_concept": f"""SELECT ticker, concept, {END}, value FROM f1 WHERE concept = 'Goodwill'
UNION ALL SELECT ticker, 'NetDebt', {END}, a.value - b.value
FROM (SELECT ticker, pe, value FROM f1 WHERE concept = 'LongTermDebt') a
JOIN (SELECT ticker, pe, value FROM f1 WHERE concept = 'CashAndEquivalents') b USING (ticker, pe)""",
    "mean_pivot": f"""SELECT ticker, {END}, avg(value) FILTER (concept = 'Revenue') AS Revenue,
  avg(value) FILTER (concept = 'Goodwill') AS Goodwill
FROM f1 WHERE concept IN ('Revenue', 'Goodwill') AND value IS NOT NULL GROUP BY ticker, pe""",
    "first_rows": f"""SELECT ticker, concept, {END}, value FROM f1
QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY pe) = 1""",
    "duplicate_warning": f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows,
  coalesce(sum(n), 0) > {K.DUPLICATE_WARNING_ROWS} AS warn FROM (
  SELECT count(*) AS n FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f1 WHERE concept = 'Goodwill')
  GROUP BY ticker, concept, pe HAVING count(*) > 1)""",
    "duplicate_keys": f"""SELECT ticker, concept, {END}, count(*) AS n_rows FROM (
  SELECT * FROM f1 UNION ALL SELECT * FROM f1 WHERE concept = 'Goodwill') GROUP BY ALL HAVING count(*) > 1""",
    **filings.STATEMENTS,
}
STATEMENTS["published_run"] = STATEMENTS["universe_manifest"]


#: statements about absence: on facts and prices that lack some values
ABOUT_GAPS = frozenset("coverage_report latest_values latest_rows scale_reference coverage_flags empty_panels null_columns "
                       "available_concepts share_history_absent tickers_without_data".split())


def oracle_sql() -> dict[str, str]:
    instead = {"nightly_facts": filings.WITHOUT_KNOWN_BAD}
    return {name: statement(sql, name in ABOUT_GAPS, instead.get(name)) for name, sql in STATEMENTS.items()}
