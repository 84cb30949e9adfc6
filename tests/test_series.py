from datetime import date, timedelta

import pytest

from quarterdeck.operators import asof, periods, ratios, timeseries as ts

from tests.conftest import rows


def long(spark, points, concept="Revenue", ticker="A"):
    return spark.createDataFrame([(ticker, concept, d, v) for d, v in points],
                                 "ticker string, concept string, end date, value double")


QUARTERS = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31),
            date(2021, 3, 31)]


def test_ttm_needs_four_adjacent_known_quarters(spark):
    out = ts.calculate_ttm(long(spark, zip(QUARTERS, [1.0, 2.0, 3.0, 4.0, 5.0])), "Revenue", "ttm")
    assert [r.ttm for r in out.orderBy("end").collect()] == [None, None, None, 10.0, 14.0]
    hole = long(spark, zip(QUARTERS[:2] + QUARTERS[3:] + [date(2021, 6, 30)], [1.0] * 5))
    assert all(r.ttm is None for r in ts.calculate_ttm(hole, "Revenue", "ttm").collect())
    missing = long(spark, zip(QUARTERS, [1.0, None, 3.0, 4.0, 5.0]))
    assert all(r.ttm is None for r in ts.calculate_ttm(missing, "Revenue", "ttm").collect())


@pytest.mark.parametrize("lag, found", [(320, False), (321, True), (410, True), (411, False)])
def test_growth_tolerance(spark, lag, found):
    now = date(2021, 6, 30)
    out = ts.calculate_growth(
        long(spark, [(now - timedelta(days=lag), 10.0), (now, 12.0)]), "Revenue", 4, "g")
    value = {r.end: r.g for r in out.collect()}[now]
    assert (value == pytest.approx(0.2)) if found else value is None


def test_growth_takes_the_nearest_row_even_if_empty(spark):
    now = date(2021, 6, 30)
    points = [(now - timedelta(days=400), 8.0), (now - timedelta(days=366), None), (now, 12.0)]
    out = ts.calculate_growth(long(spark, points), "Revenue", 4, "g")
    assert {r.end: r.g for r in out.collect()}[now] is None


def test_growth_across_zero_or_from_a_tiny_base(spark):
    for before, after in ((-1.0, 2.0), (2.0, -1.0), (1.0, 4.0)):
        out = ts.calculate_growth(
            long(spark, [(date(2020, 6, 30), before), (date(2021, 6, 30), after)]), "Revenue", 4, "g")
        assert all(r.g is None for r in out.collect())


def test_annual_ttm_fact_wins_over_the_empty_rolling_row(spark):
    facts = spark.createDataFrame(
        [("A", "Revenue", date(2020, 12, 31), 1.0, None),
         ("A", "Revenue_TTM", date(2020, 12, 31), 9.0, "annual_fact")],
        "ticker string, concept string, end date, value double, ttm_source string")
    out = ts.add_ttm_concepts(facts).filter("concept = 'Revenue_TTM'").collect()
    assert [(r.value, r.ttm_source) for r in out] == [(9.0, "annual_fact")]


def test_scale_reference_stays_within_a_company(spark):
    frame = spark.createDataFrame(
        [("A", date(2020, 3, 31), None), ("A", date(2020, 6, 30), None),
         ("B", date(2020, 3, 31), None), ("B", date(2020, 6, 30), 5.0)],
        "ticker string, end date, ref double")
    out = ts.scale_reference(frame, "ref", "scale")
    assert rows(out, "ticker", "scale") == [("A", None), ("A", None), ("B", 5.0), ("B", 5.0)]


def test_ratio_keeps_presence_and_blanks_zero(spark):
    facts = long(spark, [(QUARTERS[0], 1.0), (QUARTERS[1], None), (QUARTERS[2], 4.0)], "N").union(
        long(spark, [(QUARTERS[0], 0.0), (QUARTERS[1], 2.0)], "D"))
    out = ratios.calculate_ratio(facts, "N", "D", "r")
    assert rows(out, "end", "r") == [(QUARTERS[0], None), (QUARTERS[1], None)]


def test_price_lookback_is_ten_days(spark):
    prices = spark.createDataFrame([("A", date(2020, 6, 20), 7.0), ("A", date(2020, 6, 25), None)],
                                   "ticker string, date date, close double")
    ends = spark.createDataFrame([("A", date(2020, 6, 30)), ("A", date(2020, 7, 1))],
                                 "ticker string, end date")
    out = asof.asof_prices(ends, prices)
    assert rows(out, "end", "close", "market_price") == [
        (date(2020, 6, 30), None, 7.0), (date(2020, 7, 1), None, None)]


def test_ends_within_a_week_are_one_period(spark):
    day = date(2020, 6, 24)
    points = [(day + timedelta(days=k), float(k)) for k in (0, 7, 14, 42)]
    out = periods.merge_duplicate_ends(long(spark, points))
    assert rows(out, "value") == [(14.0,), (42.0,)]
