import random
import statistics
from datetime import date, datetime

import pytest

from quarterdeck import registry as R
from quarterdeck.concept_sources import candidate_from_mapping
from quarterdeck.functions.quantiles import group_median, group_upper_median
from quarterdeck.operators import reshape
from quarterdeck.plans import views
from quarterdeck.sources import published
from quarterdeck.sources.filings import identifier_map

from tests.conftest import rows


def test_medians_match_sorting(spark):
    rng = random.Random(7)
    data = {k: [rng.choice([rng.uniform(-5, 5), rng.lognormvariate(3, 4), 1.0, 0.0])
                for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000))}
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in group_median(frame, ["k"], "v").collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in data.items()}
    upper = {r.k: r.median for r in group_upper_median(frame, ["k"], "v").collect()}
    assert upper == {k: sorted(v)[len(v) // 2] for k, v in data.items()}


def test_registry_refuses_duplicates_and_unknown_charts():
    R.check_registry(R.METRICS)
    with pytest.raises(ValueError):
        R.check_registry([*R.METRICS, R.METRICS[0]])
    with pytest.raises(ValueError):
        R.check_registry([R.Metric("x", "pie", "X")])


def test_hidden_names_are_closed_under_derivation():
    names = R.hidden_names({"pe_ratio", "payout_ratio"})
    assert {"pe_ratio", "pe_ratio_quarterly", "EPS_TTM_CALC", "avg_pe_5y_n"} <= names
    assert "EPS_TTM_CALC" not in R.hidden_names({"pe_ratio"})


def test_candidate_modes():
    last = candidate_from_mapping({"mode": "fallback_sum", "tags": ["a"], "point_in_time": False,
                                   "fallback_sum_tags": ["b", "c"]}).sources[-1]
    assert last.kind == "sum" and last.only_if_empty and last.tags == ("b", "c")
    with pytest.raises(ValueError):
        candidate_from_mapping({"mode": "other", "tags": [], "point_in_time": False})


def test_base_concept_strips_derivations(spark):
    names = ["Revenue_TTM", "EPS_TTM_CALC", "FFO_QUARTERLY", "_TTM", "Capex"]
    out = spark.createDataFrame([(n,) for n in names], "c string").select(
        "c", reshape.base_concept("c").alias("b"))
    assert {r.c: r.b for r in out.collect()} == {
        "Revenue_TTM": "Revenue", "EPS_TTM_CALC": "EPS", "FFO_QUARTERLY": "FFO", "_TTM": "_TTM",
        "Capex": "Capex"}


def test_thin_identifier_file_fails(spark):
    entries = spark.createDataFrame([("A", 12)], "ticker string, cik_str long")
    with pytest.raises(Exception, match="only 1 entries"):
        identifier_map(entries).collect()
    assert rows(identifier_map(entries, min_entries=1), "cik") == [("0000000012",)]


def test_comparison_explains_exclusions(spark):
    day = date(2020, 6, 30)
    data = spark.createDataFrame(
        [("A", "p_tbv", day, 1.0), ("B", "p_tbv", day, 2.0), ("C", "p_tbv", day, None)],
        "ticker string, concept string, end date, value double")
    profiles = R.profiles_frame(spark, {"A": "financial", "B": "standard", "C": "financial"})
    series, excluded = views.compare(data, "p_tbv", ["A", "B", "C", "A"], profiles,
                                     R.hidden_frame(spark), 5, "2020-12-31")
    assert rows(series, "ticker", "value") == [("A", 1.0)]
    assert rows(excluded, "ticker", "reason") == [
        ("B", "for profile 'standard' not shown"), ("C", "No Data")]


def test_a_run_is_readable_only_with_its_manifest(spark, tmp_path):
    long = spark.createDataFrame([("A", date(2020, 6, 30), "roe", 1.0)],
                                 "ticker string, end date, concept string, value double")
    universe = spark.createDataFrame([("A", "standard", 1, 1, 0)],
                                     "ticker string, profile string, n_metrics long, "
                                     "n_valuation long, n_growth long")
    frames = {name: long for name in published.FRAMES} | {"universe": universe}
    requested = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    root = str(tmp_path)
    with pytest.raises(Exception):
        published.read_frame(spark, root, "r1", "metrics_long")
    manifest = published.publish(frames, requested, root, "r1", datetime(2020, 7, 1))
    assert manifest["rows"]["metrics_long"] == 1 and manifest["tickers_requested"] == 2
    assert published.read_frame(spark, root, "r1", "metrics_long", "A").count() == 1
    assert published.read_frame(spark, root, "r1", "metrics_long", "B").count() == 0
    absent = spark.read.parquet(f"{root}/r1/tickers_without_data")
    assert rows(absent, "ticker") == [("Z",)]


def test_median_of_many_tiny_values(spark):
    from pyspark.sql import functions as F

    from quarterdeck.functions.quantiles import group_median
    tiny = spark.range(200_001).select(F.lit("g").alias("g"), (F.col("id") * 2.0 ** -40).alias("v"))
    signed = spark.range(101).select(F.lit("s").alias("g"), (F.col("id") - 50.0).alias("v"))
    got = {r.g: r.median for r in group_median(tiny.unionByName(signed), ["g"], "v").collect()}
    assert got == {"g": 100_000 * 2.0 ** -40, "s": 0.0}


def test_sweep_lifts_what_both_directions_allow(spark):
    from pyspark.sql import functions as F

    from quarterdeck.operators.scale_repair import propose_scale
    rows = {"up": [5e8, 5.1e8, 5e5, None, 5.2e8, 0.0, 5.3e8], "short": [5e8, 5e2, 5e8],
            "drop": [5e8, 5e8, 5e8, 4e6, 4e6, 4e6, 4e6]}
    data = [(t, "C", i, v) for t, values in rows.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "ticker string, concept string, day int, value double").withColumn(
        "end", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))
    got = propose_scale(df).orderBy("day").collect()
    lists = {t: [r.swept for r in got if r.ticker == t] for t in rows}
    assert lists["up"] == [5e8, 5.1e8, 5e8, None, 5.2e8, 0.0, 5.3e8]
    assert lists["short"] == rows["short"]
    assert lists["drop"] == [5e8, 5e8, 5e8, 4e8, 4e8, 4e8, 4e8]


def test_one_company_opens_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    long = spark.range(20_000).select(
        F.format_string("T%04d", (F.col("id") % 500).cast("int")).alias("ticker"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 40).alias("end"),
        F.lit("roe").alias("concept"), F.col("id").cast("double").alias("value"))
    universe = long.groupBy("ticker").agg(F.lit("standard").alias("profile"), F.count("*").alias("n_metrics"),
                                          F.lit(0).alias("n_valuation"), F.lit(0).alias("n_growth"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        published.publish({name: long for name in published.FRAMES} | {"universe": universe},
                          long.select("ticker"), str(tmp_path), "r1", datetime(2020, 7, 1))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    whole = published.read_frame(spark, str(tmp_path), "r1", "metrics_long")
    one = published.read_frame(spark, str(tmp_path), "r1", "metrics_long", "T0123")
    assert one.count() == 40 and len(one.inputFiles()) == 1 < len(whole.inputFiles())
    for part in whole.rdd.glom().collect():
        keys = [(r.ticker, r.concept, r.end) for r in part]
        assert keys == sorted(keys)


def test_rows_do_not_travel_to_meet_hidden_names(spark, capsys):
    from quarterdeck.operators.visibility import drop_hidden
    from quarterdeck.session import cut_lineage

    facts = cut_lineage(spark.createDataFrame([(t, c, v) for v, (t, c) in enumerate(
        (t, c) for t in ("A", "B", "Z", None) for c in ("x", "y", None))], "ticker string, concept string, value int"))
    profiles = cut_lineage(spark.createDataFrame([("A", "bank"), ("B", None)], "ticker string, profile string"))
    hidden = spark.createDataFrame([("bank", "x"), ("standard", "y"), ("bank", None)], "profile string, concept string")
    shown = drop_hidden(facts, profiles, hidden)
    assert rows(shown, "value") == [(v,) for v in sorted((1, 2, 3, 5, 6, 8, 9, 11), key=str)]
    capsys.readouterr()
    drop_hidden(facts, profiles, hidden).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_published_rows_do_not_travel_to_meet_profiles(spark, capsys):
    from quarterdeck.plans import refresh
    from quarterdeck.session import cut_lineage

    long = cut_lineage(spark.createDataFrame([(t, c, date(2020, 3, 31), 1.0) for t in ("A", "B", "Z") for c in ("x", "y")],
                                             "ticker string, concept string, end date, value double"))
    # Spark can only guess the size of a join
    profiles = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, n int").join(
        spark.createDataFrame([(1, "bank"), (2, "insurer")], "n int, profile string"), "n").select("ticker", "profile")
    hidden = spark.createDataFrame([("bank", "x")], "profile string, concept string")
    frames = refresh.published_frames(refresh.Calculated(long, long, long, long, long, long), profiles, hidden)
    capsys.readouterr()
    for name in ("metrics_long", "valuation_history", "current_snapshot"):
        assert rows(frames[name], "ticker", "concept") == [("A", "y"), ("B", "x"), ("B", "y"), ("Z", "x"), ("Z", "y")]
        frames[name].explain()
        assert "Exchange hashpartitioning" not in capsys.readouterr().out
    assert rows(frames["universe"], "ticker", "profile", "n_metrics") == [("A", "bank", 1), ("B", "insurer", 2), ("Z", "standard", 2)]
