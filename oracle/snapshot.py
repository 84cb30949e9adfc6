"""Reference statements of the snapshot queries."""

from __future__ import annotations

from oracle.common import AS_OF, CTES, CUTOFF, CUTOFFS, rounded
from quarterdeck import registry as R

# concept and field, written out here so that a mistake in the library's own lists shows
LATEST_VALUES = dict(pair.split() for pair in """
SharesOutstanding           _filed_shares
StockholdersEquity          equity
TangibleEquity              tangible_equity
LongTermDebt                debt
CashAndEquivalents          cash
Revenue_TTM                 revenue_ttm
EPS_TTM_CALC                eps_ttm
DividendsPerShare_TTM       dividends_ttm
ShareBasedCompensation_TTM  sbc_ttm
FFO_TTM                     ffo_ttm
PPNR                        ppnr_ttm
CoreOperatingEarnings       core_earnings_ttm
""".strip().splitlines())
SAME_NAME = """
roa equity_to_assets net_interest_margin efficiency_ratio provision_ratio
loss_ratio combined_ratio expense_ratio net_investment_yield reserve_growth
inventory_turnover dio dso dpo cash_conversion_cycle
rd_intensity capex_intensity operating_leverage""".split()
LATEST_ROWS = {"FCF_TTM": "fcf_ttm", "EBITDA_TTM": "ebitda_ttm", "revenue_yoy_growth": "yoy_growth",
               **{m: m for m in SAME_NAME}}
AGED = [f"{f}_age_days" for f in LATEST_VALUES.values() if f != "_filed_shares"]
PUBLISHED = """
price shares_outstanding market_cap net_debt ev shares_source_is_edgar shares_delta_pct
equity tangible_equity debt cash revenue_ttm eps_ttm dividends_ttm ppnr_ttm core_earnings_ttm
pe_ratio pb_ratio pfcf_ratio ev_ebitda ev_sales pe_to_revenue_growth dividend_yield p_tbv p_ppnr
p_core_earnings p_ffo ev_fcf pfcf_ex_sbc""".split() + [*LATEST_ROWS.values(), *AGED]


def _snapshot(suffix: str, as_of: str, cut: str, quotes: str, peers: bool) -> str:
    """All snapshot rows; ``cut`` limits period ends."""
    concepts = ", ".join(f"'{c}'" for c in LATEST_VALUES)
    rows = ", ".join(f"'{c}'" for c in LATEST_ROWS)
    CTES[f"lv{suffix}"] = f"""
SELECT ticker, concept, pe, value, newest - pe AS age FROM (
  SELECT *, max(pe) OVER (PARTITION BY ticker, concept) AS newest,
    row_number() OVER (PARTITION BY ticker, concept ORDER BY value IS NULL, pe DESC) AS place
  FROM af WHERE concept IN ({concepts}) AND {cut}) WHERE place = 1 AND value IS NOT NULL"""
    CTES[f"lr{suffix}"] = f"""
SELECT ticker, concept, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY pe DESC) AS place FROM (
    SELECT ticker, pe, concept, value FROM metrics UNION ALL
    SELECT ticker, pe, concept, value FROM af WHERE concept IN ('FCF_TTM', 'EBITDA_TTM'))
  WHERE concept IN ({rows}) AND {cut}) WHERE place = 1"""
    CTES[f"la{suffix}"] = f"""
SELECT ticker, concept, mean, med, n FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY pe DESC) AS place
  FROM avg5 WHERE mean IS NOT NULL AND {cut}) WHERE place = 1"""
    CTES[f"newest{suffix}"] = f"SELECT ticker, max(pe) AS newest_any FROM af WHERE {cut} GROUP BY ALL"
    value = lambda c: f"(SELECT value FROM lv{suffix} v WHERE v.ticker = q.ticker AND v.concept = '{c}' AND v.age <= 365)"
    age = lambda c: f"(SELECT CAST(age AS DOUBLE) FROM lv{suffix} v WHERE v.ticker = q.ticker AND v.concept = '{c}' AND v.age BETWEEN 1 AND 365)"
    row = lambda c: f"(SELECT value FROM lr{suffix} v WHERE v.ticker = q.ticker AND v.concept = '{c}')"
    cols = [f"{value(c)} AS {f}" for c, f in LATEST_VALUES.items()]
    cols += [f"{age(c)} AS {f}_age_days" for c, f in LATEST_VALUES.items() if f != "_filed_shares"]
    cols += [f"{row(c)} AS {f}" for c, f in LATEST_ROWS.items()]
    cols.append(f"(SELECT value FROM lv{suffix} v WHERE v.ticker = q.ticker AND v.concept = 'Revenue_TTM') AS scale")
    cols.append(f"(SELECT newest_any - v.pe FROM lv{suffix} v JOIN newest{suffix} n USING (ticker) "
                f"WHERE v.ticker = q.ticker AND v.concept = 'SharesOutstanding') AS lag")
    CTES[f"s0{suffix}"] = f"SELECT q.ticker, q.price, q.shares_outstanding AS quoted, {', '.join(cols)} FROM ({quotes}) q"
    CTES[f"s1{suffix}"] = f"""
SELECT *, price * shares_outstanding AS market_cap FROM (
  SELECT *, CAST(prefer AS DOUBLE) AS shares_source_is_edgar, (_filed_shares - quoted) / quoted * 100 AS shares_delta_pct,
    CASE WHEN prefer THEN _filed_shares ELSE quoted END AS shares_outstanding
  FROM (SELECT *, coalesce(quoted > 0 AND _filed_shares > 0 AND (_filed_shares / quoted > 1.1
          OR (quoted / _filed_shares > 1.5 AND lag <= 200)), false) AS prefer FROM s0{suffix}))"""
    guard = lambda above, below: (f"CASE WHEN NOT coalesce(abs({below}) < 0.001 * abs(scale), false) "  # noqa: E731
                                  f"THEN {above} / CASE WHEN {below} > 0 THEN {below} END END")
    pos = lambda above, below: f"{above} / CASE WHEN {below} > 0 THEN {below} END"
    CTES[f"s2{suffix}"] = f"""
SELECT *, debt - cash AS net_debt, market_cap + (debt - cash) AS ev, fcf_ttm - sbc_ttm AS owner,
  {pos('price', 'eps_ttm')} AS pe_ratio FROM s1{suffix}"""
    multiples = {
        "pb_ratio": f"CASE WHEN NOT coalesce(tangible_equity < 0, false) THEN {guard('market_cap', 'equity')} END",
        "pfcf_ratio": pos("market_cap", "fcf_ttm"), "ev_ebitda": pos("ev", "ebitda_ttm"),
        "ev_sales": "ev / nullif(revenue_ttm, 0)",
        "pe_to_revenue_growth": "CASE WHEN yoy_growth > 0.02 AND abs(pe_ratio / (yoy_growth * 100)) <= 30 "
                                "AND pe_ratio > 0 THEN pe_ratio / (yoy_growth * 100) END",
        "dividend_yield": "dividends_ttm / nullif(price, 0)",
        "p_tbv": guard("market_cap", "tangible_equity"),
        "p_ppnr": "market_cap / nullif(ppnr_ttm, 0)",
        "p_core_earnings": "market_cap / nullif(core_earnings_ttm, 0)",
        "p_ffo": guard("market_cap", "ffo_ttm"), "ev_fcf": guard("ev", "fcf_ttm"),
        "pfcf_ex_sbc": guard("market_cap", "owner")}
    CTES[f"s3{suffix}"] = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in multiples.items())} FROM s2{suffix}"
    parts = [f"SELECT ticker, unnest([{', '.join(f'''{{'c': '{f}', 'v': CAST({f} AS DOUBLE)}}''' for f in PUBLISHED)}]) AS x FROM s3{suffix}"]
    for metric, f in R.FIVE_YEAR_FIELDS.items():
        parts.append(f"""SELECT ticker, unnest([{{'c': '{f}', 'v': mean}}, {{'c': '{f}_median', 'v': med}},
  {{'c': '{f}_diverges', 'v': CAST(coalesce(abs(mean - med) / nullif(med, 0) > 0.2, false) AS DOUBLE)}},
  {{'c': '{f}_history_too_short', 'v': CAST(n < 12 AS DOUBLE)}}]) AS x
  FROM la{suffix} SEMI JOIN s0{suffix} USING (ticker) WHERE concept = '{metric}'""")
    out = " UNION ALL ".join(parts)
    final = f"SELECT ticker, x.c AS concept, x.v AS value FROM ({out}) WHERE x.v IS NOT NULL"
    if peers:
        final += " UNION ALL SELECT ticker, concept, value FROM peers"
    return f"SELECT ticker, DATE '{as_of}' AS \"end\", concept, {rounded()} AS value FROM ({final})"


def _as_of(suffix: str, cutoff: str) -> str:
    return _snapshot(suffix, cutoff, f"pe <= DATE '{cutoff}'", f"""
SELECT p.ticker, p.price, s.value AS shares_outstanding FROM (
  SELECT ticker, close AS price FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS place
    FROM px WHERE dt <= DATE '{cutoff}') WHERE place = 1) p
LEFT JOIN (SELECT ticker, value FROM lv{suffix} WHERE concept = 'SharesOutstanding' AND age <= 365) s USING (ticker)""", False)


SNAPSHOT_LATEST = _snapshot("_now", AS_OF, "true", "SELECT * FROM quotes", True)
SNAPSHOT_AS_OF = _as_of("_cut", CUTOFF)
SNAPSHOTS_AS_OF = " UNION ALL ".join(_as_of(f"_cut{i}", cutoff) for i, cutoff in enumerate(CUTOFFS))
