"""How often frames are built, how they are dealt, and rolling sums against plain ones."""

import random
from datetime import date, timedelta

import pytest
import __spark_entry__ as entry
from oracle.common import AS_OF
from quarterdeck import constants as K, session
from quarterdeck.operators import timeseries as ts
from quarterdeck.plans import refresh, wide

SF = "/root/testdata/sf0.001"


def odd_facts(spark):
    """Series with ends days apart, holes, missing values and annual facts beside rolling sums."""
    rng, rows = random.Random(3), []
    for ticker in ("A", "B", "C", None):
        for concept in ("Revenue", "Revenue_TTM", "ClaimsReserve", "StockholdersEquity", "Goodwill", "Capex"):
            for k in range(14):
                end = date(2018, 3, 31) + timedelta(days=91 * k + rng.choice([0, 0, 0, 3, 30]))
                if rng.random() < 0.85:
                    rows.append((ticker, concept, end, rng.choice([None, -1.0, 0.0, rng.uniform(1, 9), rng.uniform(1, 9)])))
            rows.append((ticker, concept, None, 2.0))
    return spark.createDataFrame(rows, "ticker string, concept string, end date, value double").dropDuplicates(
        ["ticker", "concept", "end"])


def test_a_rolling_sum_adds_four_known_rows(spark):
    facts = session.cut_lineage(odd_facts(spark).filter("ticker IS NOT NULL"))
    got = {(r.ticker, r.concept, r.end): r.ttm for r in ts.with_trailing_year_sum(
        ts.with_day(facts), "value", "ttm").collect() if r.end}
    series = {}
    for r in facts.filter("end IS NOT NULL").orderBy("end").collect():
        series.setdefault((r.ticker, r.concept), []).append((r.end, r.value))
    for key, points in series.items():
        for k, (end, _) in enumerate(points):
            four = points[max(0, k - 3):k + 1]
            steps = [(b[0] - a[0]).days for a, b in zip(four, four[1:])]
            good = (len(four) == 4 and all(v is not None for _, v in four)
                    and all(K.TTM_STEP_DAYS[0] <= s <= K.TTM_STEP_DAYS[1] for s in steps)
                    and K.TTM_SPAN_DAYS[0] <= sum(steps) <= K.TTM_SPAN_DAYS[1])
            assert got[*key, end] == (sum(v for _, v in four) if good else None)
    assert any(v is not None for v in got.values())


def test_long_rows_are_dealt_by_their_number(spark, monkeypatch):
    facts = odd_facts(spark)
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    tasks = wide.series_rows(facts).rdd.getNumPartitions()
    assert tasks == -(-facts.count() // 20) > 10
    assert ts.add_ttm_concepts(facts).rdd.getNumPartitions() == tasks


def test_trailing_year_concepts_travel_once(spark, capsys):
    facts = session.cut_lineage(odd_facts(spark))
    ts.add_ttm_concepts(facts).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


@pytest.mark.parametrize("name", ["universe_manifest", "routed_values"])
def test_the_wide_frame_is_built_once(spark, monkeypatch, name):
    def again(*_):
        raise AssertionError("built a second time")
    monkeypatch.setattr(entry.wide_plan, "build_wide", again)
    assert entry.queries()[name](spark, SF).count() > 0


def test_dear_frames_are_cut_before_they_are_published(spark):
    d = entry.Data(spark, SF)
    result = refresh.calculate(d.facts, d.prices, d.quotes, d.profiles, AS_OF)
    lazy = refresh.published_frames(result, d.profiles, d.hidden)
    frames = refresh.written_once(lazy, d.profiles)
    for name in ("facts_full", "current_snapshot", "universe"):
        assert all("cut-" in f for f in frames[name].inputFiles())
    assert sorted(frames["universe"].collect()) == sorted(lazy["universe"].collect())
    assert set(frames) == set(lazy)


def test_the_wide_frame_reads_facts_twice(spark):
    """Once for period ends and the number of rows, once for the rows."""
    facts, read = odd_facts(spark), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    prices = spark.createDataFrame([("A", date(2018, 1, 2), 5.0), ("B", date(2019, 1, 2), None)], "ticker string, date date, close double")
    seen = facts.mapInArrow(counted, facts.schema)
    got = wide.build_wide(seen, prices).collect()
    assert read.value == 2 * facts.count()
    assert {(x.ticker, x.end) for x in got} == {(x.ticker, x.end) for x in facts.collect()}
    assert [x._close for x in got if x.ticker == "A" and x.end] == [5.0] * sum(x.ticker == "A" and x.end is not None for x in got)
