"""Reference statements of the filing-fact queries."""

from __future__ import annotations

from oracle.common import CTES, _QEND, ttm_of
from quarterdeck import concept_sources as C
from quarterdeck import constants as K
from quarterdeck import registry as R
from quarterdeck.sources import tables as T

_items = T.raw_items()
_fields = [n for n in _items[0] if n != "when"]
_structs = ", ".join(
    "CASE WHEN {} THEN {{{}}} END".format(i["when"], ", ".join(f"'{n}': {i[n]}" for n in _fields))
    for i in _items)
CTES["raw"] = f"""
SELECT 'S' || s AS ticker, x.tag AS tag, x.unit AS unit, x.unit_pos AS unit_pos, x.ordinal AS ordinal,
  x.start AS st, x.pe AS pe, x.val AS val, x.filed AS filed,
  CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS fp, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form,
  x.accn AS accn, x.pe - x.start AS days
FROM (SELECT s, q, unnest([{_structs}]) AS x FROM (
  SELECT b.*, sp.split_day, sum(net) OVER y AS net_ytd, sum(returned) OVER y AS returned_ytd,
    CAST(date_trunc('year', pe) AS DATE) AS year_start, CAST(date_trunc('quarter', pe) AS DATE) AS quarter_start,
    pe + 35 AS filed_first, pe + 400 AS filed_again, 'A' || s || '-' || qi AS accn_first,
    'A' || s || '-' || (qi + 4) AS accn_again
  FROM (SELECT *, year(pe) AS year, quarter(pe) AS q, year(pe) * 4 + quarter(pe) AS qi FROM sums) b
  LEFT JOIN (SELECT l_suppkey AS s, min(CAST(l_shipdate AS DATE)) AS split_day FROM lineitem
             WHERE year(l_shipdate) = 1998 AND l_suppkey % 10 = 0 GROUP BY ALL) sp USING (s)
  WINDOW y AS (PARTITION BY s, year ORDER BY pe)))
WHERE x.tag IS NOT NULL"""
_units = "CASE unit WHEN 'USD' THEN 0 WHEN 'USD/shares' THEN 1 WHEN 'shares' THEN 2 ELSE 3 + unit_pos END"
CTES["rawu"] = f"SELECT * FROM (SELECT *, min({_units}) OVER (PARTITION BY ticker, tag) AS best FROM raw) WHERE {_units} = best"


def _dedup(lo: int, hi: int) -> str:
    return f"""
SELECT ticker, tag, pe, days, st, val AS value, filed, first_ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, tag, pe, days ORDER BY filed DESC, ordinal) AS place,
    min(ordinal) OVER (PARTITION BY ticker, tag, pe, days) AS first_ordinal
  FROM rawu WHERE days BETWEEN {lo} AND {hi}) WHERE place = 1"""


CTES["dur"] = _dedup(80, 380)
CTES["dura"] = _dedup(350, 380)


def _fold(where: str) -> str:
    """Sequential rule over the document order of each end."""
    return f"""
SELECT ticker, tag, pe, best.val AS value, best.filed AS filed FROM (
  SELECT ticker, tag, pe, list_reduce(list({{'days': days, 'filed': filed, 'val': val}} ORDER BY ordinal),
    lambda a, b: CASE WHEN a.days IS NULL OR b.days IS NULL OR a.days = b.days
        THEN CASE WHEN b.filed > a.filed THEN b ELSE a END
        ELSE CASE WHEN b.days < a.days THEN b ELSE a END END) AS best
  FROM rawu WHERE {where} GROUP BY ALL)"""


CTES["pit"] = _fold("days IS NULL OR days BETWEEN 80 AND 120 OR days BETWEEN 350 AND 380")
CTES["pita"] = _fold("fp = 'FY'")
CTES["lad"] = """
SELECT *, value - coalesce(lag(value) OVER g, 0) AS step_value, days - coalesce(lag(days) OVER g, 0) AS step_days,
  days BETWEEN 350 AND 380 AS annual, lag(days) OVER g IS NOT NULL AS has_prev,
  min(first_ordinal) OVER (PARTITION BY ticker, tag, st) AS group_ordinal
FROM dur d WHERE NOT (days BETWEEN 350 AND 380 AND NOT EXISTS (
  SELECT 1 FROM dur x WHERE x.ticker = d.ticker AND x.tag = d.tag AND x.st = d.st AND x.days BETWEEN 80 AND 120))
WINDOW g AS (PARTITION BY ticker, tag, st ORDER BY pe)"""
CTES["steps"] = """
SELECT ticker, tag, pe, step_value AS value, filed FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.ticker, l.tag, l.pe ORDER BY group_ordinal DESC) AS place
  FROM lad l LEFT JOIN (SELECT ticker, tag, count(*) AS n FROM lad WHERE (has_prev OR NOT annual)
      AND step_days BETWEEN 101 AND 120 GROUP BY ALL) c ON l.ticker = c.ticker AND l.tag = c.tag
  WHERE (l.has_prev OR NOT l.annual) AND (step_days BETWEEN 80 AND 100
    OR (step_days BETWEEN 101 AND 120 AND coalesce(c.n, 0) >= 3))) WHERE place = 1"""
CTES["fourth"] = """
SELECT a.ticker, a.tag, a.pe, any_value(a.value) - sum(q.value) AS value, any_value(a.filed) AS filed
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, pe ORDER BY group_ordinal) AS place FROM lad WHERE annual) a
JOIN (SELECT a.pe AS ape, s.*, row_number() OVER (PARTITION BY s.ticker, s.tag, a.pe ORDER BY s.pe DESC) AS back
      FROM (SELECT DISTINCT ticker, tag, pe FROM lad WHERE annual) a
      JOIN steps s ON a.ticker = s.ticker AND a.tag = s.tag AND s.pe < a.pe AND a.pe - s.pe <= 300) q
  ON q.ticker = a.ticker AND q.tag = a.tag AND q.ape = a.pe AND q.back <= 3
WHERE a.place = 1 AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.ticker = a.ticker AND s.tag = a.tag AND s.pe = a.pe)
GROUP BY a.ticker, a.tag, a.pe HAVING count(*) = 3"""
CTES["quarters"] = "SELECT * FROM steps UNION ALL SELECT * FROM fourth"
CTES["yearly"] = """
SELECT ticker, tag, pe, value, filed FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, pe
  ORDER BY first_ordinal) AS place FROM dura) WHERE place = 1"""
_source_rows = ", ".join(
    f"('{p}', '{c}', {six}, '{s.kind}', '{tag}', {str(cand.point_in_time).lower()}, "
    f"{str(cand.non_negative).lower()}, {repr(s.require) if s.require else 'NULL'})"
    for p in sorted(set(T.PROFILE_BY_REGION))
    for c, cand in {**C.BASE, **C.BY_PROFILE.get(p, {})}.items()
    for six, s in enumerate(cand.sources) for tag in s.tags)
CTES["sources"] = (f"SELECT * FROM (VALUES {_source_rows}) AS v(profile, concept, ix, kind, tag, pit, nonneg, req)")
CTES["excluded"] = "SELECT * FROM (VALUES {}) AS v(profile, concept)".format(
    ", ".join(f"('{p}', '{c}')" for p, cs in R.EXCLUDED_BY_PROFILE.items() for c in cs))


def _merge(flow: str, instant: str) -> str:
    return f"""
SELECT ticker, concept, pe, value, filed, tag FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, concept, pe ORDER BY ix) AS place FROM (
    SELECT p.ticker, s.concept, s.ix, v.pe, sum(v.value) AS value, s.nonneg,
      CASE WHEN s.kind = 'tag' THEN max(v.filed) END AS filed, CASE WHEN s.kind = 'tag' THEN max(v.tag) END AS tag
    FROM profiles p JOIN sources s ON s.profile = p.profile
    JOIN (SELECT *, false AS pit FROM {flow} UNION ALL SELECT *, true FROM {instant}) v
      ON v.ticker = p.ticker AND v.tag = s.tag AND v.pit = s.pit
    WHERE s.req IS NULL OR EXISTS (SELECT 1 FROM {instant} r WHERE s.pit AND r.ticker = p.ticker AND r.tag = s.req AND r.pe = v.pe)
    GROUP BY p.ticker, s.concept, s.ix, v.pe, s.kind, s.nonneg)
  WHERE NOT nonneg OR value IS NULL OR value >= 0) WHERE place = 1"""


def _last_of_chain(table: str) -> str:
    return f"""
SELECT * EXCLUDE (ahead) FROM (SELECT *, lead(pe) OVER (PARTITION BY ticker, concept ORDER BY pe) - pe AS ahead FROM {table})
WHERE ahead IS NULL OR ahead > 7"""


CTES["merged"] = _merge("quarters", "pit")
CTES["mergeda"] = _merge("yearly", "pita")
CTES["series"] = _last_of_chain("merged")
CTES["seriesa"] = _last_of_chain("mergeda")
_ttm = ", ".join(f"'{c}'" for c in K.TTM_CONCEPTS)
CTES["annualttm"] = f"""
SELECT ticker, concept || '_TTM' AS concept, pe, value FROM seriesa a WHERE concept IN ({_ttm}) AND NOT EXISTS (
  SELECT 1 FROM ({ttm_of('(SELECT ticker, concept, pe, value FROM series)')}) t
  WHERE t.ticker = a.ticker AND t.concept = a.concept || '_TTM' AND t.value IS NOT NULL)"""
_share_tags = "'WeightedAverageNumberOfDilutedSharesOutstanding', 'WeightedAverageNumberOfSharesOutstandingBasic', 'CommonStockSharesOutstanding'"
CTES["restated"] = f"""
SELECT * FROM (SELECT ticker, tag, unit, pe, lag(filed) OVER w AS earlier, filed AS later, val / nullif(lag(val) OVER w, 0) AS ratio,
    val, lag(val) OVER w AS before
  FROM raw WHERE val <> 0 WINDOW w AS (PARTITION BY ticker, tag, unit, pe ORDER BY filed, val))
WHERE earlier <> later AND val > 0 AND before > 0"""
CTES["confirmed"] = f"""
SELECT DISTINCT p.ticker, p.dt, p.stock_split AS ratio FROM px p
WHERE p.stock_split > 0 AND abs(ln(p.stock_split)) >= 0.182 AND EXISTS (
  SELECT 1 FROM restated r WHERE r.ticker = p.ticker AND r.tag IN ({_share_tags})
    AND r.earlier < p.dt AND p.dt <= r.later AND abs(ln(r.ratio / p.stock_split)) < 0.02)"""

# --- share counts in the wrong unit of scale ----------------------------------
# a company's counts on the current split basis
CTES["counts"] = """
SELECT s.ticker, s.pe, s.filed, s.value AS filed_value, s.value * coalesce(product(c.ratio) FILTER (c.dt > s.filed), 1) AS value
FROM series s LEFT JOIN confirmed c USING (ticker) WHERE s.concept = 'SharesOutstanding' GROUP BY s.ticker, s.pe, s.filed, s.value"""
CTES["lined"] = """
SELECT ticker, pe, value, up, row_number() OVER (PARTITION BY ticker, up ORDER BY CASE WHEN up THEN pe END, CASE WHEN NOT up THEN pe END DESC) AS rn
FROM counts CROSS JOIN (VALUES (true), (false)) AS d(up)"""
# the level goes from value to value; a value far below it is taken up by the factor that fits best
CTES["walked"] = """
WITH RECURSIVE w AS (
  SELECT ticker, up, CAST(0 AS BIGINT) AS rn, list_sort(list(log10(abs(value))) FILTER (value <> 0))[count(*) FILTER (value <> 0) // 2 + 1] AS level,
    CAST(NULL AS INTEGER) AS power FROM lined WHERE rn <= 5 GROUP BY ticker, up
  UNION ALL
  SELECT ticker, up, rn,
    CASE WHEN own IS NULL THEN level WHEN level IS NULL OR abs(own - level) <= 1.5 THEN own
      WHEN own > level OR best IS NULL THEN level ELSE own + best END,
    CASE WHEN own IS NOT NULL AND level IS NOT NULL AND abs(own - level) > 1.5 AND own < level THEN best END
  FROM (SELECT *, list_sort(list_transform(list_filter([2, 3, 4, 5, 6, 7], lambda p: abs(own + p - level) <= 0.5),
            lambda p: {'off': abs(own + p - level), 'p': p}))[1].p AS best
        FROM (SELECT w.ticker, w.up, l.rn, w.level, CASE WHEN l.value <> 0 THEN log10(abs(l.value)) END AS own
              FROM w JOIN lined l ON l.ticker = w.ticker AND l.up = w.up AND l.rn = w.rn + 1)))
SELECT l.ticker, l.pe, l.up, w.power FROM w JOIN lined l USING (ticker, up, rn)"""
CTES["sweep"] = """
SELECT c.*, CASE WHEN n >= 4 AND p IS NOT NULL THEN value * power(10.0, p) ELSE value END AS swept FROM (
  SELECT c.*, count(*) OVER (PARTITION BY c.ticker) AS n,
    CASE WHEN f.power IS NULL OR b.power IS NULL OR f.power = b.power THEN coalesce(f.power, b.power) END AS p
  FROM counts c JOIN walked f ON f.ticker = c.ticker AND f.pe = c.pe AND f.up
  JOIN walked b ON b.ticker = c.ticker AND b.pe = c.pe AND NOT b.up) c"""
CTES["proposed"] = "SELECT ticker, pe, filed_value, swept / value AS factor FROM sweep WHERE value <> 0 AND swept <> value"
CTES["shr"] = f"SELECT * FROM raw WHERE val IS NOT NULL AND tag IN ({_share_tags})"
CTES["eps"] = "SELECT * FROM raw WHERE val IS NOT NULL AND tag IN ('EarningsPerShareDiluted', 'EarningsPerShareBasic')"
_income_tags = ", ".join(f"'{t}'" for s in C.BASE["NetIncomeLoss"].sources for t in s.tags)
CTES["inc"] = f"SELECT * FROM raw WHERE val IS NOT NULL AND tag IN ({_income_tags})"
_FILING = "{0}.ticker = {1}.ticker AND {0}.accn = {1}.accn AND {0}.pe = {1}.pe AND {0}.st IS NOT DISTINCT FROM {1}.st"


def _reported(table: str) -> str:
    """Filings that reported just the number in question for its end."""
    return f"""SELECT DISTINCT p.ticker, p.pe, x.accn, x.st, p.filed_value, p.factor FROM (SELECT * FROM {table}) p
JOIN shr x ON x.ticker = p.ticker AND x.pe = p.pe WHERE x.val <> 0 AND abs(x.val / p.filed_value - 1) < 1e-9"""


def _errors(reported: str) -> str:
    """What income over shares over earnings per share comes to, for all numbers of a filing that meet."""
    return f"""SELECT r.ticker, r.pe, log10(abs((i.val / r.filed_value) / e.val)) AS error, abs(i.val) AS income FROM {reported} r
JOIN eps e ON {_FILING.format('e', 'r')} JOIN inc i ON {_FILING.format('i', 'r')} WHERE abs(e.val) > 1e-6 AND i.val <> 0"""


_MIDDLE = "list_sort(list({0}))[count(*) // 2 + 1]"
CTES["reporting"] = _reported("proposed")
CTES["judged"] = f"""
SELECT p.ticker, p.pe, p.factor, CASE
  WHEN EXISTS (SELECT 1 FROM shr x WHERE x.ticker = p.ticker AND x.pe = p.pe AND x.val > 0 AND abs((x.val / p.filed_value) / p.factor - 1) < 0.02)
    OR EXISTS (SELECT 1 FROM reporting r JOIN inc i ON {_FILING.format('i', 'r')}
               JOIN inc o ON o.ticker = r.ticker AND o.pe = r.pe AND o.st IS NOT DISTINCT FROM r.st
               WHERE r.ticker = p.ticker AND r.pe = p.pe AND i.val <> 0 AND abs((o.val / i.val) / p.factor - 1) < 0.02)
    OR coalesce(abs(m.implied - log10(p.factor)) < 0.35, false) THEN 'supported'
  WHEN abs(m.implied) < 0.35 THEN 'refuted' ELSE 'unknown' END AS verdict
FROM proposed p LEFT JOIN (SELECT ticker, pe, {_MIDDLE.format('error')} AS implied FROM ({_errors('reporting')}) GROUP BY ALL) m
  ON m.ticker = p.ticker AND m.pe = p.pe"""
CTES["scaled"] = """
SELECT s.ticker, s.pe, s.filed, s.filed_value, CASE WHEN j.verdict = 'refuted' THEN s.value ELSE coalesce(s.swept, s.value) END AS value
FROM sweep s LEFT JOIN judged j USING (ticker, pe)"""
CTES["outside"] = f"""
SELECT ticker, pe, value, filed_value, others, 1.0 AS factor FROM (
  SELECT a.ticker, a.pe, a.value, a.filed_value, {_MIDDLE.format('log10(abs(b.value))')} AS others, count(*) AS n
  FROM scaled a JOIN scaled b ON b.ticker = a.ticker AND b.pe <> a.pe AND b.value <> 0
  WHERE a.value > 0 AND a.filed_value <> 0 GROUP BY ALL)
WHERE n >= 5 AND abs(log10(value) - others) >= 2"""
CTES["sibling"] = """
SELECT ticker, pe, arg_min(CAST(round(gap) AS INTEGER), rank) AS power FROM (
  SELECT o.ticker, o.pe, o.value, o.filed_value, o.others, x.val, log10(o.filed_value / x.val) AS gap,
    {'seen': min(x.place) OVER (PARTITION BY o.ticker, o.pe, x.accn, x.st), 'place': x.place} AS rank
  FROM outside o JOIN (SELECT *, CASE WHEN tag LIKE 'WeightedAverageNumberOfDiluted%' THEN 0 WHEN tag LIKE 'Weighted%' THEN 1 ELSE 2 END * 1e9
                         + unit_pos * 1e6 + ordinal AS place FROM shr) x ON x.ticker = o.ticker AND x.pe = o.pe AND x.val > 0
  WHERE EXISTS (SELECT 1 FROM shr y WHERE y.ticker = o.ticker AND y.pe = o.pe AND y.accn = x.accn AND y.val <> 0 AND abs(y.val / o.filed_value - 1) < 1e-9))
WHERE gap >= 0.7 AND abs(gap - round(gap)) <= 0.05 AND abs(log10(val * (value / filed_value)) - others) < 1 GROUP BY ALL"""
CTES["outreport"] = _reported("outside")
CTES["unsound"] = f"""
SELECT e.ticker, e.pe FROM (SELECT ticker, pe, {_MIDDLE.format('error')} AS implied, {_MIDDLE.format('income')} AS typical
  FROM ({_errors('outreport')}) GROUP BY ALL) e
JOIN (SELECT ticker, {_MIDDLE.format('log10(abs(val))')} AS usual FROM inc WHERE val <> 0 GROUP BY ticker HAVING count(*) >= 5) u USING (ticker)
WHERE abs(e.implied) >= 2 AND abs(log10(e.typical) - u.usual) < 1"""
CTES["decided"] = """
SELECT o.ticker, o.pe, s.power, CASE WHEN s.power IS NOT NULL THEN 'rescaled' WHEN u.ticker IS NOT NULL THEN 'dropped' ELSE 'kept' END AS action
FROM outside o LEFT JOIN sibling s ON s.ticker = o.ticker AND s.pe = o.pe LEFT JOIN unsound u ON u.ticker = o.ticker AND u.pe = o.pe"""
CTES["repaired"] = """
SELECT s.ticker, s.pe, CASE WHEN d.action = 'rescaled' THEN s.value / power(10.0, d.power) ELSE s.value END AS value
FROM scaled s LEFT JOIN decided d ON d.ticker = s.ticker AND d.pe = s.pe WHERE d.action IS NULL OR d.action <> 'dropped'"""
CTES["allraw"] = CTES["raw"]
#: the facts without the corrections' known wrong ones
WITHOUT_KNOWN_BAD = {"raw": "SELECT * FROM allraw WHERE NOT (tag = 'Goodwill' AND ordinal % 50 = 0)"}
_summed = "sum(value) FILTER (tag IN ('Depreciation', 'AmortizationOfIntangibleAssets'))"
_whole = "max(value) FILTER (tag = 'DepreciationDepletionAndAmortization')"
_n = "CAST(substr(ticker, 2) AS BIGINT) % 4"

END = 'pe AS "end"'
STATEMENTS = {
    "unit_choice": "SELECT DISTINCT ticker, tag, unit FROM rawu",
    "latest_filed_dedup": f"SELECT ticker, tag, {END}, CAST(days AS INTEGER) AS days, value, filed FROM dur",
    "instant_dedup": f"SELECT ticker, tag, {END}, value, filed FROM pit",
    "q4_derive": f"SELECT ticker, tag, {END}, value, filed FROM quarters",
    "annual_extract": f"SELECT ticker, tag, {END}, value, filed FROM yearly",
    "concept_merge": f"SELECT ticker, concept, {END}, value, filed, tag FROM merged",
    "sources_resolved": "SELECT p.ticker, s.concept, s.ix AS source_ix, s.tag FROM profiles p JOIN sources s USING (profile)",
    "annual_ttm_gate": f"SELECT ticker, concept, {END}, value FROM annualttm",
    "known_bad_antijoin": f"SELECT ticker, tag, {END}, filed, val FROM raw WHERE NOT (tag = 'Goodwill' AND ordinal % 50 = 0)",
    "masks": f"""SELECT ticker, concept, {END}, value FROM series
WHERE NOT (concept IN ({", ".join(f"'{c}'" for c in (*K.NON_NEGATIVE_FLOWS, *K.NON_NEGATIVE_BALANCES))}) AND coalesce(value < 0, false))
  AND NOT (concept = 'OperatingCashFlow' AND month(pe) = 6)""",
    "restatement_pairs": f"SELECT ticker, tag, unit, {END}, earlier, later, ratio FROM restated",
    "split_corroboration": "SELECT ticker, dt AS date, ratio FROM confirmed",
    "split_basis": f"""SELECT s.ticker, {END.replace('pe', 's.pe')}, s.value * coalesce(product(c.ratio) FILTER (c.dt > s.filed), 1) AS value
FROM series s LEFT JOIN confirmed c USING (ticker) WHERE s.concept = 'SharesOutstanding' GROUP BY s.ticker, s.pe, s.value""",
    "shares_basis": """SELECT ticker, CASE WHEN tag LIKE 'Weighted%' THEN 0.0 ELSE 1.0 END AS shares_basis FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pe DESC) AS place FROM merged WHERE concept = 'SharesOutstanding') WHERE place = 1""",
    "refresh_gate": """SELECT r.ticker, r.reported, f.published FROM (
  SELECT ticker, max(pe) AS reported FROM raw WHERE pe <= DATE '2001-06-30' + CAST(substr(ticker, 2) AS INTEGER) % 3 * 100 GROUP BY ALL) r
JOIN (SELECT ticker, max(report_date) AS published FROM subs GROUP BY ALL) f USING (ticker)
WHERE f.published > r.reported AND CAST(substr(r.ticker, 2) AS INTEGER) % 5 <> 0""",
    "tag_search": "SELECT DISTINCT ticker, tag FROM raw WHERE lower(tag) LIKE '%longtermdebt%' OR lower(tag) LIKE '%revenue%'",
    "override_audit": """SELECT ticker, CASE WHEN k % 3 = 0 THEN lpad(CAST(k AS VARCHAR), 10, '0') ELSE lpad(CAST(k + 1 AS VARCHAR), 10, '0') END AS cik,
  CASE WHEN k % 4 <> 0 THEN lpad(CAST(k AS VARCHAR), 10, '0') END AS from_file,
  CASE WHEN k % 4 = 0 THEN 'absent' WHEN k % 3 = 0 THEN 'REDUNDANT' ELSE 'CONTESTED' END AS status
FROM (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS k FROM supplier)""",
    "identifier_map": """SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 6 = 0 THEN 'override' ELSE lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik
FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 6 = 0""",
    "cadence": """SELECT ticker, concept, CASE WHEN count(DISTINCT src) > 1 THEN 'mixed' ELSE 'annual' END AS cadence FROM (
  SELECT ticker, concept, 'annual_fact' AS src FROM annualttm UNION ALL
  SELECT ticker, concept, 'quarterly_rolling' FROM ({ttm}) WHERE value IS NOT NULL) GROUP BY ALL
HAVING count(DISTINCT src) > 1 OR min(src) = 'annual_fact'""".format(
        ttm=ttm_of("(SELECT ticker, concept, pe, value FROM series)", K.TTM_CONCEPTS)),
    "filings_ingested": f"""SELECT ticker, tag, unit, unit_pos, CAST(row_number() OVER (PARTITION BY ticker, tag, unit ORDER BY ordinal) - 1 AS INTEGER) AS ordinal,
  st AS start, {END}, val, filed, fp, CAST(year(pe) AS INTEGER) AS fy, form, accn FROM raw""",
    "documents_set_aside": "SELECT ticker, CAST(1 AS BIGINT) AS n_documents FROM (SELECT DISTINCT ticker FROM raw) WHERE CAST(substr(ticker, 2) AS BIGINT) % 7 = 0",
    "scale_sweep": f"SELECT ticker, {END}, value, swept FROM sweep",
    "scale_evidence": f"SELECT ticker, {END}, round(factor, 3) AS factor, verdict FROM judged",
    "directional_repair": f"SELECT ticker, {END}, power, action FROM decided",
    "scale_repair": f"SELECT ticker, 'SharesOutstanding' AS concept, {END}, value FROM repaired",
    "merge_modes": f"""
SELECT ticker, concept, {END}, value FROM merged WHERE (concept = 'Revenue' AND {_n} <> 0)
  OR (concept = 'DepreciationAndAmortization' AND {_n} NOT IN (1, 2)) OR (concept = 'LongTermDebt' AND {_n} <> 2)
UNION ALL SELECT ticker, 'Revenue', pe, sum(value) FROM quarters
WHERE {_n} = 0 AND tag IN ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax') GROUP BY ticker, pe
UNION ALL SELECT ticker, 'DepreciationAndAmortization', pe, value FROM (
  SELECT ticker, pe, coalesce({_whole}, {_summed}) AS value FROM quarters WHERE {_n} = 1 GROUP BY ticker, pe) WHERE value IS NOT NULL
UNION ALL SELECT ticker, 'DepreciationAndAmortization', pe, value FROM (
  SELECT ticker, pe, CASE WHEN ticker IN (SELECT ticker FROM quarters WHERE tag = 'DepreciationDepletionAndAmortization')
    THEN {_whole} ELSE {_summed} END AS value FROM quarters WHERE {_n} = 2 GROUP BY ticker, pe) WHERE value IS NOT NULL
UNION ALL SELECT ticker, 'LongTermDebt', pe, value FROM (
  SELECT ticker, pe, coalesce(max(value) FILTER (tag = 'LongTermDebt' AND value >= 0),
    CASE WHEN count(*) FILTER (tag = 'LongTermDebtNoncurrent') > 0 AND sum(value) FILTER (tag <> 'LongTermDebt') >= 0
      THEN sum(value) FILTER (tag <> 'LongTermDebt') END) AS value
  FROM pit WHERE {_n} = 2 AND tag IN ('LongTermDebt', 'LongTermDebtNoncurrent', 'LongTermDebtCurrent', 'NotesPayableCurrent')
  GROUP BY ticker, pe) WHERE value IS NOT NULL""",
    "nightly_facts": f"""
SELECT ticker, concept, {END}, value, CAST(NULL AS VARCHAR) AS ttm_source FROM (
  SELECT ticker, concept, pe, value FROM series WHERE concept <> 'SharesOutstanding'
  UNION ALL SELECT ticker, 'SharesOutstanding', pe, value FROM repaired)
WHERE NOT (concept IN ({", ".join(f"'{c}'" for c in (*K.NON_NEGATIVE_FLOWS, *K.NON_NEGATIVE_BALANCES))}) AND coalesce(value < 0, false))
  AND NOT (concept = 'OperatingCashFlow' AND month(pe) = 6)
UNION ALL SELECT ticker, concept, {END}, value, '{K.TTM_ANNUAL}' FROM annualttm""",
}
