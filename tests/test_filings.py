import json
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from quarterdeck import schemas
from quarterdeck.operators import filing_periods as fp
from quarterdeck.operators import scale_repair as scale
from quarterdeck.operators.tag_merge import first_source_wins
from quarterdeck.session import ROWS_PER_FILE, cut_lineage
from quarterdeck.sources.filings import flatten_submissions, read_company_facts

from tests.conftest import rows


def raw(spark, items, tag="T"):
    """items: (start, end, val, filed) in document order."""
    data = [("A", tag, "USD", 0, i, s, e, v, f, "Q1", 2020, "10-Q", f"a{i}")
            for i, (s, e, v, f) in enumerate(items)]
    return spark.createDataFrame(data, schemas.RAW_FACTS)


def test_instants_with_and_without_span_replay_document_order(spark):
    end, filed = date(2020, 6, 30), date(2020, 8, 1)
    days = lambda n: end - timedelta(days=n)
    items = [(None, end, 1.0, filed), (days(90), end, 2.0, filed + timedelta(days=1)),
             (days(365), end, 3.0, filed + timedelta(days=9)), (None, end, 4.0, filed),
             (days(89), end, 5.0, filed - timedelta(days=9)), (None, end, 6.0, filed)]
    # 1 -> 2 (later) -> 2 (longer span) -> 2 (earlier) -> 5 (shorter) -> 6 (later than 5)
    out = fp.tag_series(raw(spark, items), "quarterly", True)
    assert rows(out, "value") == [(6.0,)]


def replayed(items):
    """The rule one filing after the other: (span or None, filed, value) in document order."""
    best = None
    for span, filed, value in items:
        if best is None:
            best = span, filed, value
        elif None not in (span, best[0]) and span != best[0]:
            best = (span, filed, value) if span < best[0] else best
        elif filed > best[1]:
            best = span, filed, value
    return best


def test_mixed_spans_fold_in_chunks_like_a_replay(spark):
    rng, end, tags = random.Random(7), date(2020, 6, 30), {}
    for t in range(40):
        # past the first chunk, and with ordinals that lie chunks and runs apart
        count = rng.choice([2, 3, 5, 30, 700, 1500])
        step = rng.choice([1, 1, 300, 70_000]) if count < 100 else 1
        tags[f"T{t}"] = [(step * i, rng.choice([None, None, 85, 90, 360]),
                          date(2020, 7, 1) + timedelta(days=rng.randrange(12)), float(i)) for i in range(count)]
    data = [("A", tag, "USD", 0, o, None if d is None else end - timedelta(days=d), end, v, f, "Q1", 2020, "10-Q", "a")
            for tag, items in tags.items() for o, d, f, v in items]
    out = fp.tag_series(spark.createDataFrame(data, schemas.RAW_FACTS), "quarterly", True)
    assert rows(out, "tag", "value", "filed") == sorted(
        (tag, best[2], best[1]) for tag, best in ((t, replayed(i[1:] for i in items)) for t, items in tags.items()))


def test_a_million_filings_of_one_end(spark):
    span = F.element_at(F.expr("array(NULL, 80, 90, 360)"), (F.xxhash64("id", F.lit(1)) % 4 + 4).cast("int") % 4 + 1)
    facts = spark.range(0, 1_000_000, 1, 4).select(
        F.lit("A").alias("ticker"), F.lit("T").alias("tag"), F.lit("USD").alias("unit"), F.lit(0).alias("unit_pos"),
        F.col("id").cast("int").alias("ordinal"), F.date_sub(F.lit(date(2020, 6, 30)), span).alias("start"),
        F.lit(date(2020, 6, 30)).alias("end"), F.col("id").cast("double").alias("val"),
        F.date_add(F.lit(date(2020, 7, 1)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(20)).cast("int")).alias("filed"),
        F.lit("Q1").alias("fp"), F.lit(2020).alias("fy"), F.lit("10-Q").alias("form"), F.lit("a").alias("accn"))
    items = facts.select(F.datediff("end", "start").alias("days"), "filed", "val").orderBy("ordinal").toPandas()
    best = replayed((None if d != d else int(d), f, v) for d, f, v in zip(items.days, items.filed, items.val))
    out = fp.tag_series(facts, "quarterly", True)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "value", "filed") == [(best[2], best[1])]


def test_a_cut_deals_a_frame_that_grew_out_of_few_rows(spark):
    grown = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(3 * ROWS_PER_FILE))).alias("n"), F.lit("x").alias("t"))
    cut = cut_lineage(grown.coalesce(1))
    per_file = cut.groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(per_file) == 3 and {r["count"] for r in per_file} == {ROWS_PER_FILE}
    assert cut.schema.simpleString() == grown.schema.simpleString()
    assert cut.agg(F.sum("n")).first()[0] == 3 * ROWS_PER_FILE * (3 * ROWS_PER_FILE + 1) // 2


def test_ladders_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "TASK_ROWS", 40)
    starts = [date(2020, 1, 1), date(2020, 4, 1), date(2020, 7, 1), date(2020, 10, 1)]
    ends = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31)]
    ladder = [(starts[0], e, 10.0 * (i + 1) ** 2, date(2021, 2, 1)) for i, e in enumerate(ends)]
    data = [("A", f"T{t}", "USD", 0, i, s, e, v + t, f, "Q1", 2020, "10-Q", "a")
            for t in range(300) for i, (s, e, v, f) in enumerate(ladder)]
    out = fp.tag_series(spark.createDataFrame(data, schemas.RAW_FACTS), "quarterly", False)
    assert rows(out.filter("tag = 'T7'"), "end", "value") == list(zip(ends, [17.0, 30.0, 50.0, 70.0]))
    assert out.count() == 1200 and out.select(F.spark_partition_id()).distinct().count() > 20


def test_sixteen_week_quarters_need_three_of_a_kind(spark):
    def ladder(year, spans):
        start, items, total = date(year, 1, 1), [], 0.0
        for k, span in enumerate(spans, 1):
            total += k
            items.append((start, start + timedelta(days=sum(spans[:k])), total, date(year + 1, 2, 1)))
        return items
    three = [i for y in (2018, 2019, 2020) for i in ladder(y, [84, 84, 84, 112])]
    assert fp.tag_series(raw(spark, three), "quarterly", False).count() == 12
    two = [i for y in (2018, 2019) for i in ladder(y, [84, 84, 84, 112])]
    out = fp.tag_series(raw(spark, two), "quarterly", False)
    # the long fourth quarter is not accepted, so it comes from the annual figure
    assert rows(out, "value") == [(1.0,), (1.0,), (2.0,), (2.0,), (3.0,), (3.0,), (4.0,), (4.0,)]


def test_last_resort_source_only_for_empty_series(spark):
    schema = ("ticker string, concept string, source_ix int, end date, value double, filed date, "
              "tag string, non_negative boolean, only_if_empty boolean")
    day = date(2020, 6, 30)
    cells = [("A", "C", 0, day, -1.0, None, "x", True, False),
             ("A", "C", 1, day, 5.0, None, "y", True, False),
             ("A", "C", 2, date(2020, 9, 30), 7.0, None, None, True, True),
             ("B", "C", 2, day, 9.0, None, None, False, True)]
    out = first_source_wins(spark.createDataFrame(cells, schema))
    assert rows(out, "ticker", "value") == [("A", 5.0), ("B", 9.0)]


def test_nested_documents_keep_their_order(spark, tmp_path):
    item = {"end": "2020-06-30", "val": 5, "filed": "2020-08-01", "fp": "Q2", "fy": 2020,
            "form": "10-Q", "accn": "x"}
    body = {"facts": {"us-gaap": {"Assets": {"units": {"EUR": [item], "USD": [item, item]}}}}}
    (tmp_path / "ABC_company_info.json").write_text(json.dumps(body))
    out = read_company_facts(spark, str(tmp_path))
    assert rows(out, "ticker", "unit", "unit_pos", "ordinal") == [
        ("ABC", "EUR", 0, 0), ("ABC", "USD", 1, 0), ("ABC", "USD", 1, 1)]
    assert rows(fp.preferred_units(out), "unit") == [("USD",)]


def test_submissions_are_parallel_arrays(spark):
    documents = spark.createDataFrame(
        [("A", ((["10-K", "8-K"], ["2020-12-31", ""], ["2021-02-01", "2021-03-01"]),))],
        "ticker string, filings struct<recent struct<form array<string>, "
        "reportDate array<string>, filingDate array<string>>>")
    assert rows(flatten_submissions(documents), "form", "report_date") == [
        ("10-K", date(2020, 12, 31)), ("8-K", None)]


# --- share counts in the wrong scale ----------------------------------------

ENDS = [date(2018, 3, 31) + timedelta(days=91 * k) for k in range(9)]


def series(spark, values):
    return spark.createDataFrame(
        [("A", "SharesOutstanding", e, float(v), float(v)) for e, v in zip(ENDS, values)],
        "ticker string, concept string, end date, value double, filed_value double")


def filed(spark, values):
    """values: (accn, end, val) of one reporting period each."""
    data = [("A", a, date(1, 1, 1), e, float(v), 1, i) for i, (a, e, v) in enumerate(values)]
    return spark.createDataFrame(
        data, "ticker string, accn string, start date, end date, val double, n long, position long")


def corrected(spark, values, shares, eps, income):
    evidence = tuple(filed(spark, part) for part in (shares, eps, income))
    out = scale.corroborated_scale(series(spark, values), lambda _: evidence)
    return [r.value for r in out.orderBy("end").collect()]


def test_scale_corrections_follow_the_evidence(spark):
    values = [100e6, 101e6, 99e6, 102e3, 100e6, 103e6, 98e6, 100e6, 101e6]
    bad = ENDS[3]
    shares = [(f"a{i}", e, v) for i, (e, v) in enumerate(zip(ENDS, values))]
    lifted = values[:3] + [102e6] + values[4:]
    assert corrected(spark, values, shares, [], []) == lifted
    # earnings per share that fit the number as filed refute the correction
    assert corrected(spark, values, shares, [("a3", bad, 2.0)], [("a3", bad, 2.0 * 102e3)]) == values
    # the same period reported elsewhere at the corrected size overrules that
    assert corrected(spark, values, [*shares, ("z", bad, 102e6)], [("a3", bad, 2.0)],
                     [("a3", bad, 2.0 * 102e3)]) == lifted
    # so does a net income restated by the same factor
    assert corrected(spark, values, shares, [("a3", bad, 2.0)],
                     [("a3", bad, 204e3), ("b9", bad, 204e6)]) == lifted


def test_far_too_large_counts(spark):
    values = [100e6, 101e6, 99e6, 102e9, 100e6, 103e6, 98e6, 100e6, 101e6]
    bad, shares = ENDS[3], [(f"a{i}", e, v) for i, (e, v) in enumerate(zip(ENDS, values))]

    def repaired(shares, eps, income):
        evidence = tuple(filed(spark, part) for part in (shares, eps, income))
        out = scale.directional_repair(series(spark, values), lambda _: evidence)
        return [r.value for r in out.orderBy("end").collect()]

    assert repaired([*shares, ("a3", bad, 104e6)], [], []) == values[:3] + [102e6] + values[4:]
    assert repaired(shares, [], []) == values
    income = [(f"a{i}", e, 200e6) for i, e in enumerate(ENDS)]
    assert repaired(shares, [("a3", bad, 2.0)], income) == values[:3] + values[4:]


def test_series_of_one_concept_is_that_of_all(spark, tmp_path):
    """Masks and share counts take the facts of their own tags alone."""
    import __spark_entry__ as entry
    from quarterdeck.plans.facts import SHARES
    data = entry.Data(spark, entry.SMOKE_DIR)
    for concept in (SHARES, "OperatingCashFlow"):
        one = data.series_of(concept)
        assert one.count() > 0 and one.columns == data.series.columns
        whole = data.series.filter(F.col("concept") == concept)
        assert one.exceptAll(whole).count() == whole.exceptAll(one).count() == 0
    plan = entry.Data(spark, entry.SMOKE_DIR)
    entry.QUERIES["scale_repair"](plan)
    assert "series" not in vars(plan) and "readable" not in vars(plan)


def test_unit_choice_and_corrections_keep_null_keys_as_they_were(spark):
    rows = [("A", "x", "EUR", 0, "2020-03-31", "2020-05-01", 1.0), ("A", "x", "USD", 1, "2020-03-31", "2020-05-01", 2.0),
            ("B", "x", "EUR", 0, "2020-03-31", "2020-05-01", 3.0), ("B", "y", "EUR", 0, "2020-03-31", "2020-05-01", 4.0),
            ("B", None, "EUR", 0, "2020-03-31", "2020-05-01", 5.0), ("B", "y", "GBP", None, "2020-03-31", "2020-05-01", 6.0),
            (None, "x", "USD", 0, "2020-03-31", "2020-05-01", 7.0)]
    raw = spark.createDataFrame(rows, "ticker string, tag string, unit string, unit_pos int, end string, filed string, val double")
    assert sorted(r.val for r in fp.in_preferred_unit(raw).collect()) == [2.0, 3.0, 4.0]
    bad = raw.filter("val IN (1, 5)")
    left = fp.drop_known_bad(raw, bad)
    assert sorted(r.val for r in left.collect()) == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert left.columns == ["ticker", "tag", "end", "filed", "val", "unit", "unit_pos"]
    assert sorted(r.val for r in fp.of_tags(raw, raw.select("ticker", "tag").filter("val = 3")).collect()) == [1.0, 2.0, 3.0][2:]


def test_sources_of_companies_are_not_built_on_the_driver(spark, capsys):
    """A cut of companies and sources takes few bytes, so Spark would broadcast any number of their rows."""
    from quarterdeck.operators import tag_merge as tm
    from quarterdeck.plans import facts as facts_plan

    config = [(c, 0, i, tag, role, kind, instant, False, False) for c, instant, kind, terms in (
        ("Revenue", False, "tag", [("Revenues", "term")]), ("Assets", True, "tag", [("Assets", "term")]),
        ("LongTermDebt", True, "sum", [("Long", "term"), ("Short", "term"), ("Long", "require")])) for i, (tag, role) in enumerate(terms)]
    sources = cut_lineage(spark.createDataFrame([(t, *row) for t in ("A", "B") for row in config], "ticker string, concept string, "
        "source_ix int, tag_ix int, tag string, role string, kind string, point_in_time boolean, non_negative boolean, only_if_empty boolean"))
    end = date(2020, 12, 31)
    # B has no source for Other, a null company has none at all, and Short alone makes no debt
    items = [("A", "Revenues", date(2020, 10, 1), 1.0), ("A", "Assets", None, 2.0), ("A", "Long", None, 3.0), ("A", "Short", None, 4.0),
             ("B", "Revenues", date(2020, 1, 1), 5.0), ("B", "Short", None, 6.0), ("B", "Other", None, 7.0), (None, "Assets", None, 8.0), ("C", "Assets", None, 9.0)]
    raw = cut_lineage(spark.createDataFrame([(t, tag, "USD", 0, i, start, end, v, date(2021, 2, 1), "FY", 2020, "10-K", f"a{i}")
                                             for i, (t, tag, start, v) in enumerate(items)], schemas.RAW_FACTS))
    series = tm.concept_series(raw, sources)
    assert rows(series, "ticker", "concept", "value", "tag") == [
        ("A", "Assets", 2.0, "Assets"), ("A", "LongTermDebt", 7.0, None), ("A", "Revenue", 1.0, "Revenues")]
    series = cut_lineage(series)
    annual = facts_plan.annual_ttm_rows(series, raw, sources)
    assert rows(annual, "ticker", "concept", "value") == [("B", "Revenue_TTM", 5.0)]
    masked = tm.drop_masked_periods(series, series.filter("concept = 'Assets'"))
    assert rows(masked, "concept") == [("LongTermDebt",), ("Revenue",)]
    capsys.readouterr()
    for frame in (tm.concept_series(raw, sources), annual, masked, fp.drop_known_bad(raw, raw.filter("val = 7")),
                  fp.of_tags(raw, sources.select("ticker", "tag")), scale.filing_values(raw, facts_plan.tags_of(sources, "Assets"))):
        frame.explain()
        plan = capsys.readouterr().out
        keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[(ticker[^]]*)]", plan)}
        # ends whose filings are replayed are few and their size is that of a shuffle
        assert keys <= {"ticker, tag, end", "ticker, tag, end, _run"} and "SortMergeJoin [ticker" in plan
