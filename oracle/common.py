"""Shared common table expressions of the reference statements.

Each entry is one CTE; ``statement`` collects the ones a final SELECT needs.  The text
follows the textbook definition (joins of long rows), not the Spark plan.
"""

from __future__ import annotations

import re

from quarterdeck import constants as K
from quarterdeck import registry as R
from quarterdeck.sources import tables as T

AS_OF, CUTOFF = "2002-02-15", "2000-06-30"
CUTOFFS = ("1997-03-31", "1999-01-15", CUTOFF)

CTES: dict[str, str] = {}
GAPPED_CTES: dict[str, str] = {}


def statement(final: str, gaps: bool = False, instead: dict[str, str] | None = None) -> str:
    """``final`` with the CTEs it needs; with ``gaps``, on facts and prices that lack some values;
    ``instead`` puts other CTEs in the place of those of the same names."""
    ctes = (CTES | GAPPED_CTES if gaps else CTES) | (instead or {})
    names, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in names and re.search(rf"\b{name}\b", text):
                names.add(name)
                todo.append(ctes[name])
    ordered, done = [], set()

    def place(name: str) -> None:
        if name not in done:
            done.add(name)
            for other in CTES:
                if other in names and other != name and re.search(rf"\b{other}\b", ctes[name]):
                    place(other)
            ordered.append(name)

    for name in CTES:
        if name in names:
            place(name)
    if not ordered:
        return final
    body = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in ordered)
    return f"WITH {body}\n{final}"


def cents(c: str) -> str:
    return f"CAST(floor({c} * 100 + 0.5) AS BIGINT)"


def rounded(expr: str = "value") -> str:
    return f"CASE WHEN abs({expr}) < 1e6 THEN round({expr}, 6) ELSE {expr} END"


_PRICE, _DISC, _TAX = cents("l_extendedprice"), cents("l_discount"), cents("l_tax")
_QEND = "CAST(last_day(date_trunc('quarter', CAST({c} AS DATE)) + INTERVAL 2 MONTH) AS DATE)"

CTES["sums"] = f"""
SELECT l_suppkey AS s, {_QEND.format(c='l_shipdate')} AS pe,
  sum({_PRICE} * (100 - {_DISC})) AS net, sum({_PRICE} * {_TAX}) AS tax,
  sum({_PRICE} * {_DISC}) AS disc,
  sum(CASE WHEN l_returnflag = 'A' THEN {_PRICE} * 100 ELSE 0 END) AS accepted,
  sum(CASE WHEN l_returnflag = 'R' THEN {_PRICE} * 100 ELSE 0 END) AS returned,
  sum(CAST(l_quantity AS BIGINT)) AS qty, count(*) AS lines
FROM lineitem GROUP BY ALL"""


def _mix(mix: dict[str, int]) -> str:
    return " + ".join(f"{name} * ({factor})" for name, factor in mix.items())


_cells = ", ".join(
    f"{{'concept': '{c}', 'value': CAST({_mix(m)} AS DOUBLE)}}" for c, m in T.FACT_MIX.items())
_gapped_cells = ", ".join(
    f"{{'concept': '{c}', 'value': CASE WHEN (s + year(pe) * 4 + quarter(pe) + {i}) % 23 <> 0 "
    f"THEN CAST({_mix(m)} AS DOUBLE) END, 'kept': (s + {i}) % 17 <> 16}}"
    for i, (c, m) in enumerate(T.FACT_MIX.items()))
CTES["f1"] = f"""
SELECT 'S' || s AS ticker, x.concept AS concept, pe, x.value AS value
FROM (SELECT s, pe, unnest([{_cells}]) AS x FROM sums)"""
GAPPED_CTES["f1"] = f"""
SELECT 'S' || s AS ticker, x.concept AS concept, pe, x.value AS value
FROM (SELECT s, pe, unnest([{_gapped_cells}]) AS x FROM sums) WHERE x.kept"""
CTES["f2"] = f"""
SELECT 'C' || o_custkey AS ticker, 'Revenue' AS concept, {_QEND.format(c='o_orderdate')} AS pe,
  CAST(sum({cents('o_totalprice')}) AS DOUBLE) AS value
FROM orders GROUP BY ALL"""
_PX = f"""
SELECT 'S' || d.l_suppkey AS ticker, d.day AS dt, #close# AS close,
  CASE WHEN d.day = sp.split_day THEN 2.0 ELSE 0.0 END AS stock_split
FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day,
        CAST(sum({_PRICE} * 100) AS DOUBLE) / sum(CAST(l_quantity AS BIGINT)) AS close
      FROM lineitem GROUP BY ALL) d
LEFT JOIN (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS split_day FROM lineitem
           WHERE year(l_shipdate) = 1998 AND l_suppkey % 10 = 0 GROUP BY ALL) sp USING (l_suppkey)"""
CTES["px"] = _PX.replace("#close#", "d.close")
GAPPED_CTES["px"] = _PX.replace("#close#", "CASE WHEN (d.l_suppkey + day(d.day)) % 13 <> 0 THEN d.close END")
CTES["quotes"] = f"""
SELECT 'S' || l_suppkey AS ticker, CAST(cents * 100 AS DOUBLE) / qty AS price,
  CAST(qty // (16 + l_suppkey % 25) AS DOUBLE) AS shares_outstanding
FROM (SELECT l_suppkey, sum({_PRICE}) AS cents, sum(CAST(l_quantity AS BIGINT)) AS qty
      FROM lineitem GROUP BY ALL)"""
CTES["profiles"] = f"""
SELECT 'S' || s_suppkey AS ticker,
  ({list(T.PROFILE_BY_REGION)!r})[n_regionkey + 1] AS profile
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
CTES["hidden"] = "SELECT * FROM (VALUES {}) AS h(profile, concept)".format(", ".join(
    f"('{p}', '{c}')" for p, h in R.HIDDEN_BY_PROFILE.items() for c in sorted(R.hidden_names(h))))
CTES["subs"] = f"""
SELECT 'S' || s AS ticker, CASE WHEN month(pe) = 12 THEN '10-K' ELSE '10-Q' END AS form,
  pe AS report_date,
  CAST(pe + CAST(30 + (s * 7 + (year(pe) * 4 + quarter(pe)) * 3) % 15 AS INTEGER) AS DATE) AS filing_date
FROM (SELECT DISTINCT l_suppkey AS s, {_QEND.format(c='l_shipdate')} AS pe FROM lineitem)"""


def ttm_of(table: str, concepts=None) -> str:
    keep = "" if concepts is None else "WHERE concept IN ({})".format(
        ", ".join(f"'{c}'" for c in concepts))
    s, p = K.TTM_STEP_DAYS, K.TTM_SPAN_DAYS
    return f"""
SELECT ticker, concept || '_TTM' AS concept, pe,
  CASE WHEN known = 4 AND pe - d1 BETWEEN {s[0]} AND {s[1]} AND d1 - d2 BETWEEN {s[0]} AND {s[1]}
    AND d2 - d3 BETWEEN {s[0]} AND {s[1]} AND pe - d3 BETWEEN {p[0]} AND {p[1]} THEN total END AS value
FROM (SELECT *, count(value) OVER four AS known, sum(value) OVER four AS total,
        lag(pe, 1) OVER w AS d1, lag(pe, 2) OVER w AS d2, lag(pe, 3) OVER w AS d3
      FROM {table} {keep}
      WINDOW w AS (PARTITION BY ticker, concept ORDER BY pe),
        four AS (PARTITION BY ticker, concept ORDER BY pe ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def growth_of(table: str, ratio: str = "0.33", where: str = "true") -> str:
    return f"""
SELECT ticker, concept, pe, value,
  CASE WHEN before > 0 AND value > 0 AND before >= {ratio} * value THEN value / before - 1 END AS growth
FROM (SELECT a.ticker, a.concept, a.pe, a.value, b.value AS before,
        row_number() OVER (PARTITION BY a.ticker, a.concept, a.pe
                           ORDER BY abs((a.pe - b.pe) - 365.25)) AS place
      FROM (SELECT * FROM {table} WHERE {where}) a
      LEFT JOIN {table} b ON a.ticker = b.ticker AND a.concept = b.concept
        AND a.pe - b.pe BETWEEN 321 AND 410) WHERE place = 1"""


CTES["a0"] = f"SELECT * FROM f1 UNION ALL {ttm_of('f1', K.TTM_CONCEPTS)}"


def pick(concept: str) -> str:
    return f"(SELECT ticker, pe, value FROM a0 WHERE concept = '{concept}')"


def _derived(name: str, expr: str, *inputs: str, optional: str | None = None) -> str:
    joins = f"{pick(inputs[0])} a"
    for alias, concept in zip("bc", inputs[1:]):
        joins += f" JOIN {pick(concept)} {alias} USING (ticker, pe)"
    if optional:
        joins += f" LEFT JOIN {pick(optional)} o USING (ticker, pe)"
    return f"SELECT ticker, '{name}' AS concept, pe, {expr} AS value FROM {joins}"


_parts = [_derived("TangibleEquity", "a.value - b.value", "StockholdersEquity", "Goodwill")]
for _sfx, _eps, _ppnr, _core, _ffo, _fcf, _ebitda in (
        ("_TTM", "EPS_TTM_CALC", "PPNR", "CoreOperatingEarnings", "FFO_TTM", "FCF_TTM", "EBITDA_TTM"),
        ("", "EPS_QUARTERLY_CALC", "PPNR_QUARTERLY", "CoreOperatingEarnings_QUARTERLY",
         "FFO_QUARTERLY", "FCF_QUARTERLY", "EBITDA_QUARTERLY")):
    _parts += [
        _derived(_eps, "a.value / nullif(b.value, 0)", f"NetIncomeLoss{_sfx}", "SharesOutstanding"),
        _derived(_ppnr, "a.value + b.value - c.value", f"NetInterestIncome{_sfx}",
                 f"NoninterestIncome{_sfx}", f"NoninterestExpense{_sfx}"),
        _derived(_core, "a.value - b.value", f"NetIncomeLoss{_sfx}", f"RealizedInvestmentGains{_sfx}"),
        _derived(_ffo, "a.value + b.value - coalesce(o.value, 0)", f"NetIncomeLoss{_sfx}",
                 f"DepreciationAndAmortization{_sfx}", optional=f"GainLossOnSaleOfProperties{_sfx}"),
        _derived(_fcf, "a.value - b.value", f"OperatingCashFlow{_sfx}", f"Capex{_sfx}"),
        _derived(_ebitda, "a.value + b.value", f"OperatingIncomeLoss{_sfx}",
                 f"DepreciationAndAmortization{_sfx}"),
    ]
CTES["derived"] = " UNION ALL ".join(_parts)
CTES["af"] = "SELECT * FROM a0 UNION ALL SELECT * FROM derived"


def _of(concept: str) -> str:
    return f"(SELECT ticker, pe, value FROM af WHERE concept = '{concept}')"


def ratio(name: str, above: str, below: str, positive: bool = False, factor: str = "") -> str:
    den = "CASE WHEN b.value > 0 THEN b.value END" if positive else "nullif(b.value, 0)"
    return (f"SELECT ticker, pe, '{name}' AS concept, a.value / {den}{factor} AS value "
            f"FROM {_of(above)} a JOIN {_of(below)} b USING (ticker, pe)")


def guarded_ratio(name: str, above: str, below: str, ref: str, share: float) -> str:
    return f"""SELECT ticker, pe, '{name}' AS concept,
  CASE WHEN coalesce(abs(den) < {share} * abs(coalesce(before, after)), false) THEN NULL
       ELSE num / den END AS value
FROM (SELECT *, last_value(ref IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pe
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
        first_value(ref IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pe
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
      FROM (SELECT ticker, pe, a.value AS num, CASE WHEN b.value > 0 THEN b.value END AS den, r.value AS ref
            FROM {_of(above)} a JOIN {_of(below)} b USING (ticker, pe)
            LEFT JOIN {_of(ref)} r USING (ticker, pe)))"""


def self_guarded(name: str, above: str) -> str:
    return f"""SELECT ticker, pe, '{name}' AS concept,
  CASE WHEN coalesce(abs(rev) < 0.1 * (SELECT 1 * biggest), false) THEN NULL ELSE num / nullif(rev, 0) END AS value
FROM (SELECT *, max(abs(rev)) OVER (PARTITION BY ticker ORDER BY pe
        RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 730 DAY FOLLOWING) AS biggest
      FROM (SELECT ticker, pe, a.value AS num, b.value AS rev
            FROM {_of(above)} a JOIN {_of('Revenue_TTM')} b USING (ticker, pe)))""".replace("(SELECT 1 * biggest)", "biggest")


METRIC_SHARE, DEBT_SHARE = 0.01, 0.05
# the definitions, written out here so that a mistake in the library's own tables shows
_DIVISIONS = """
net_interest_margin        = NetInterestIncome_TTM / Assets
roa                        = NetIncomeLoss_TTM / Assets
equity_to_assets           = StockholdersEquity / Assets
net_investment_yield       = NetInvestmentIncome_TTM / Investments
inventory_turnover         = CostOfRevenue_TTM / Inventory
dio                        = Inventory / CostOfRevenue_TTM * 365
dpo                        = AccountsPayable / CostOfRevenue_TTM * 365
dso                        = AccountsReceivable / Revenue_TTM * 365
efficiency_ratio           = NoninterestExpense_TTM / Revenue_TTM
efficiency_ratio_quarterly = NoninterestExpense / Revenue
provision_ratio            = ProvisionForCreditLosses_TTM / Revenue_TTM
provision_ratio_quarterly  = ProvisionForCreditLosses / Revenue
rd_intensity               = ResearchAndDevelopment_TTM / Revenue_TTM
rd_intensity_quarterly     = ResearchAndDevelopment / Revenue
capex_intensity            = Capex_TTM / Revenue_TTM
capex_intensity_quarterly  = Capex / Revenue
ffo_margin                 = FFO_TTM / Revenue_TTM
ffo_margin_quarterly       = FFO_QUARTERLY / Revenue
operating_margin_quarterly = OperatingIncomeLoss / Revenue
fcf_margin_quarterly       = FCF_QUARTERLY / Revenue
combined_ratio             = BenefitsLossesAndExpenses_TTM / EarnedPremiums_TTM
combined_ratio_quarterly   = BenefitsLossesAndExpenses / EarnedPremiums
loss_ratio                 = IncurredLosses_TTM / EarnedPremiums_TTM
loss_ratio_quarterly       = IncurredLosses / EarnedPremiums
"""


def _divisions() -> list[str]:
    lines = [line.split() for line in _DIVISIONS.strip().splitlines()]
    return [ratio(name, above, below, factor=" ".join(["", *factor]))
            for name, _, above, _, below, *factor in lines]


def _ratios() -> list[str]:
    out = _divisions()
    out += [ratio("payout_ratio", "DividendsPerShare_TTM", "EPS_TTM_CALC", True),
            ratio("payout_ratio_quarterly", "DividendsPerShare", "EPS_QUARTERLY_CALC", True)]
    out += [guarded_ratio("effective_tax_rate", "IncomeTaxExpense_TTM", "PretaxIncome_TTM", "Revenue_TTM", METRIC_SHARE),
            guarded_ratio("roe", "NetIncomeLoss_TTM", "StockholdersEquity", "Revenue_TTM", METRIC_SHARE),
            guarded_ratio("rotce", "NetIncomeLoss_TTM", "TangibleEquity", "Revenue_TTM", METRIC_SHARE),
            guarded_ratio("debt_to_equity", "LongTermDebt", "StockholdersEquity", "LongTermDebt", DEBT_SHARE)]
    out += [self_guarded("operating_margin", "OperatingIncomeLoss_TTM"),
            self_guarded("fcf_margin", "FCF_TTM")]
    for name, concept in (("revenue_yoy_growth", "Revenue_TTM"), ("income_yoy_growth", "NetIncomeLoss_TTM"),
                          ("operating_income_yoy_growth", "OperatingIncomeLoss_TTM"),
                          ("reserve_growth", "ClaimsReserve")):
        inner = growth_of("af", where=f"concept = '{concept}'")
        out.append(f"SELECT ticker, pe, '{name}' AS concept, growth AS value FROM ({inner})")
    out.append(f"SELECT ticker, pe, 'net_debt' AS concept, a.value - b.value AS value "
               f"FROM {_of('LongTermDebt')} a JOIN {_of('CashAndEquivalents')} b USING (ticker, pe)")
    return out


CTES["m1"] = " UNION ALL ".join(_ratios())


def _m(concept: str) -> str:
    return f"(SELECT ticker, pe, value FROM m1 WHERE concept = '{concept}')"


def _pair(name: str, expr: str, a: str, b: str) -> str:
    return (f"SELECT ticker, pe, '{name}' AS concept, {expr} AS value "
            f"FROM {a} a JOIN {b} b USING (ticker, pe)")


CTES["m2"] = " UNION ALL ".join([
    _pair("expense_ratio", "a.value - b.value", _m("combined_ratio"), _m("loss_ratio")),
    _pair("expense_ratio_quarterly", "a.value - b.value", _m("combined_ratio_quarterly"),
          _m("loss_ratio_quarterly")),
    _pair("rule_of_40", "a.value + b.value", _m("revenue_yoy_growth"), _m("fcf_margin")),
    f"SELECT ticker, pe, 'cash_conversion_cycle' AS concept, a.value + b.value - c.value AS value "
    f"FROM {_m('dio')} a JOIN {_m('dso')} b USING (ticker, pe) JOIN {_m('dpo')} c USING (ticker, pe)",
    _pair("net_debt_to_ebitda",
          "CASE WHEN abs(b.value) >= 10000000 AND abs(a.value / nullif(b.value, 0)) <= 60 "
          "THEN a.value / b.value END", _m("net_debt"), _of("EBITDA_TTM")),
    _pair("operating_leverage",
          "CASE WHEN abs(b.value) >= 0.02 AND abs(a.value / nullif(b.value, 0)) <= 15 "
          "THEN a.value / b.value END", _m("operating_income_yoy_growth"), _m("revenue_yoy_growth")),
])


def _lagged(concept: str) -> str:
    return (f"(SELECT ticker, pe, value, lag(value) OVER w AS prev, lag(pe) OVER w AS prev_pe, "
            f"coalesce(pe - lag(pe) OVER w BETWEEN 60 AND 120, false) AS gap_ok "
            f"FROM af WHERE concept = '{concept}' WINDOW w AS (PARTITION BY ticker ORDER BY pe))")


CTES["price_at"] = """
SELECT e.ticker, e.pe, p.close AS market_price
FROM (SELECT DISTINCT ticker, pe FROM af) e
ASOF JOIN (SELECT * FROM px WHERE close IS NOT NULL) p ON e.ticker = p.ticker AND e.pe >= p.dt
WHERE e.pe - p.dt <= 10"""
CTES["buyback"] = f"""
SELECT ticker, pe, 'buyback_distortion_flag' AS concept,
  CAST(coalesce(1 - s.value / s.prev > 0.15 AND n.value > 0, false) AS DOUBLE) AS value
FROM {_lagged('StockholdersEquity')} s LEFT JOIN {_of('NetIncomeLoss_TTM')} n USING (ticker, pe)
WHERE s.gap_ok AND s.value > 0 AND s.prev > 0"""
CTES["inorganic"] = f"""
SELECT ticker, pe, 'inorganic_contaminated' AS concept,
  CAST(coalesce(value / prev - 1 > 0.20, false) AS DOUBLE) AS value
FROM {_lagged('Goodwill')} WHERE gap_ok AND prev > 0"""
CTES["jump_here"] = f"""
SELECT ticker, s.pe, s.prev_pe,
  CAST(coalesce(abs(s.value / s.prev - 1) > 0.15, false)
       AND NOT coalesce(greatest(abs(r.value), abs(i.value))
             / CASE WHEN p.market_price > 0 THEN p.market_price END
             >= 0.5 * abs(s.value - s.prev), false) AS DOUBLE) AS value
FROM {_lagged('SharesOutstanding')} s
LEFT JOIN {_of('StockRepurchased')} r USING (ticker, pe)
LEFT JOIN {_of('StockIssued')} i USING (ticker, pe)
LEFT JOIN price_at p USING (ticker, pe)
WHERE s.gap_ok AND s.prev > 0"""
CTES["jump"] = """
SELECT ticker, pe, 'share_count_jump_flag' AS concept, max(value) AS value
FROM (SELECT ticker, pe, value FROM jump_here
      UNION ALL SELECT ticker, prev_pe, 1.0 FROM jump_here WHERE value = 1.0) GROUP BY ALL"""
CTES["flags"] = f"""
SELECT * FROM buyback UNION ALL SELECT * FROM inorganic UNION ALL SELECT * FROM jump
UNION ALL {_pair('fcf_exceeds_ebitda', 'CAST(a.value > b.value AS DOUBLE)', _of('FCF_TTM'), _of('EBITDA_TTM'))}
  WHERE a.value > 0 AND b.value > 0
UNION ALL SELECT ticker, pe, 'low_tax_rate_flag' AS concept, CAST(value < 0.1 AS DOUBLE) AS value
  FROM {_m('effective_tax_rate')} WHERE value IS NOT NULL"""
CTES["metrics"] = """
SELECT * FROM m1 WHERE concept <> 'net_debt' UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM flags"""

# --- valuation --------------------------------------------------------------


#: what the multiples below read
NEEDED = ("Revenue_TTM", "EPS_TTM_CALC", "DividendsPerShare_TTM", "FCF_TTM", "FFO_TTM", "EBITDA_TTM",
          "ShareBasedCompensation_TTM", "PPNR", "CoreOperatingEarnings", "StockholdersEquity",
          "TangibleEquity", "LongTermDebt", "CashAndEquivalents", "SharesOutstanding")


def _needed() -> str:
    return ", ".join(f"'{c}'" for c in NEEDED)


def canonical_of(table: str, concepts: str) -> str:
    return f"""
SELECT ticker, pe, first_value(pe) OVER (PARTITION BY ticker, cluster ORDER BY n DESC, pe DESC) AS canonical
FROM (SELECT *, sum(starts) OVER (PARTITION BY ticker ORDER BY pe) AS cluster
      FROM (SELECT ticker, pe, n, CASE WHEN coalesce(pe - lag(pe) OVER (PARTITION BY ticker ORDER BY pe), 99) > 7
                    THEN 1 ELSE 0 END AS starts
            FROM (SELECT ticker, pe, count(DISTINCT concept) AS n FROM {table}
                  WHERE concept IN ({concepts}) GROUP BY ALL)))"""


CTES["canonical"] = canonical_of("af", _needed())


def _vwide() -> str:
    picks = ", ".join(f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}" for c in NEEDED)
    return f"""
SELECT ticker, canonical AS pe, {picks}
FROM (SELECT c.ticker, c.canonical, a.concept, a.value,
        row_number() OVER (PARTITION BY c.ticker, c.canonical, a.concept ORDER BY a.pe DESC) AS place
      FROM af a JOIN canonical c ON a.ticker = c.ticker AND a.pe = c.pe
      WHERE a.concept IN ({_needed()}))
WHERE place = 1 AND value IS NOT NULL GROUP BY ALL"""


CTES["vwide"] = _vwide()
CTES["vgrowth"] = f"""
SELECT ticker, canonical AS pe, growth FROM (
  SELECT g.ticker, c.canonical, g.value AS growth,
    row_number() OVER (PARTITION BY g.ticker, c.canonical ORDER BY g.pe DESC) AS place
  FROM {_m('revenue_yoy_growth')} g JOIN canonical c USING (ticker, pe)) WHERE place = 1"""
CTES["vbuyback"] = """
SELECT ticker, canonical AS pe, value AS buyback_distortion_flag FROM (
  SELECT b.ticker, c.canonical, b.value,
    row_number() OVER (PARTITION BY b.ticker, c.canonical ORDER BY b.pe DESC) AS place
  FROM buyback b JOIN canonical c USING (ticker, pe)) WHERE place = 1"""


def _guard(value: str, den: str) -> str:
    return f"CASE WHEN NOT coalesce(abs({den}) < 0.001 * abs(scale), false) THEN {value} END"


def _pos(above: str, below: str) -> str:
    return f"{above} / CASE WHEN {below} > 0 THEN {below} END"


CTES["vbase"] = """
SELECT *, close * shares AS cap, close * shares + (LongTermDebt - CashAndEquivalents) AS ev,
  FCF_TTM - ShareBasedCompensation_TTM AS owner_fcf, EPS_TTM_CALC * shares AS earnings
FROM (
  SELECT v.*, p.close, g.growth, b.buyback_distortion_flag,
    CASE WHEN count(v.SharesOutstanding) OVER (PARTITION BY v.ticker) > 0 THEN v.SharesOutstanding
         ELSE q.shares_outstanding END AS shares,
    coalesce(last_value(v.Revenue_TTM IGNORE NULLS) OVER (PARTITION BY v.ticker ORDER BY v.pe
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(v.Revenue_TTM IGNORE NULLS) OVER (PARTITION BY v.ticker ORDER BY v.pe
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS scale
  FROM vwide v
  ASOF LEFT JOIN px p ON v.ticker = p.ticker AND v.pe >= p.dt
  LEFT JOIN vgrowth g ON v.ticker = g.ticker AND v.pe = g.pe
  LEFT JOIN vbuyback b ON v.ticker = b.ticker AND v.pe = b.pe
  LEFT JOIN quotes q ON v.ticker = q.ticker)"""
_multiples = {
    "pe_ratio": _guard(_pos("close", "EPS_TTM_CALC"), "earnings"),
    "pb_ratio": "CASE WHEN NOT coalesce(TangibleEquity < 0, false) THEN "
                + _guard(_pos("cap", "StockholdersEquity"), "StockholdersEquity") + " END",
    "pfcf_ratio": _guard(_pos("cap", "FCF_TTM"), "FCF_TTM"),
    "ev_fcf": _guard(_pos("ev", "FCF_TTM"), "FCF_TTM"),
    "pfcf_ex_sbc": _guard(_pos("cap", "owner_fcf"), "owner_fcf"),
    "ev_ebitda": _guard(_pos("ev", "EBITDA_TTM"), "EBITDA_TTM"),
    "ev_sales": _pos("ev", "Revenue_TTM"),
    "dividend_yield": "CASE WHEN DividendsPerShare_TTM >= 0 THEN DividendsPerShare_TTM END / nullif(close, 0)",
    "p_tbv": _guard(_pos("cap", "TangibleEquity"), "TangibleEquity"),
    "p_ppnr": _guard(_pos("cap", "PPNR"), "PPNR"),
    "p_core_earnings": _guard(_pos("cap", "CoreOperatingEarnings"), "CoreOperatingEarnings"),
    "p_ffo": _guard(_pos("cap", "FFO_TTM"), "FFO_TTM"),
}
_cols = ", ".join(f"{e} AS {n}" for n, e in _multiples.items())
_peg = ("CASE WHEN growth > 0.02 AND abs(pe_ratio / (growth * 100)) <= 30 "
        "THEN pe_ratio / (growth * 100) END")
_names = [*_multiples, "pe_to_revenue_growth", "buyback_distortion_flag"]
CTES["vh"] = f"""
SELECT ticker, pe, x.concept AS concept, x.value AS value FROM (
  SELECT ticker, pe, unnest([{", ".join(f"{{'concept': '{n}', 'value': {n}}}" for n in _names)}]) AS x
  FROM (SELECT *, {_peg} AS pe_to_revenue_growth
        FROM (SELECT ticker, pe, growth, buyback_distortion_flag, {_cols} FROM vbase)))"""
_harmonic = ", ".join(f"'{c}'" for c in R.HARMONIC_METRICS)
CTES["sound"] = f"""
SELECT v.* FROM vh v ANTI JOIN (SELECT ticker, pe FROM jump WHERE value = 1.0) j
  ON v.ticker = j.ticker AND v.pe = j.pe WHERE v.concept IN ({_harmonic})"""
CTES["avg5"] = """
SELECT a.ticker, a.concept, a.pe, count(b.value) / nullif(sum(1 / b.value), 0) AS mean,
  median(b.value) AS med, count(b.value) AS n
FROM sound a LEFT JOIN sound b ON a.ticker = b.ticker AND a.concept = b.concept
  AND b.pe > a.pe - 1826 AND b.pe <= a.pe AND b.value > 0
GROUP BY ALL"""
CTES["peers"] = f"""
SELECT ticker, concept || '_band_elevated' AS concept, CAST(low > med AS DOUBLE) AS value
FROM (SELECT *, count(*) OVER g AS n, median(latest) OVER g AS med
      FROM (SELECT s.ticker, s.concept, coalesce(p.profile, 'standard') AS profile,
              min(s.value) AS low, arg_max(s.value, s.pe) AS latest
            FROM sound s LEFT JOIN profiles p ON s.ticker = p.ticker
            WHERE s.value > 0 AND s.pe > DATE '{AS_OF}' - 1826 AND s.pe <= DATE '{AS_OF}' GROUP BY ALL)
      WINDOW g AS (PARTITION BY profile, concept)) WHERE n >= 5"""
