"""Published runs: six frames and a manifest that is written last."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarterdeck import constants as K
from quarterdeck.constants import DEFAULT_PROFILE
from quarterdeck.registry import GROWTH_PANELS

FRAMES = ("metrics_long", "valuation_history", "facts_growth", "facts_full",
          "current_snapshot", "universe")
MANIFEST = "manifest"
ZONES = "zones"


def growth_export(facts: DataFrame) -> DataFrame:
    """The narrow frame the growth charts read."""
    return facts.filter(F.col("concept").isin(*GROWTH_PANELS)).select(
        "ticker", "concept", "end", "yoy_growth")


def universe(metrics: DataFrame, history: DataFrame, growth: DataFrame,
             profiles: DataFrame) -> DataFrame:
    """Every company of any frame with its profile and row counts.

    Each frame is counted by itself first, so what meets is one row per company and frame.
    """
    counted = None
    for frame, name in ((metrics, "n_metrics"), (history, "n_valuation"), (growth, "n_growth")):
        part = frame.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "frame", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    totals = counted.groupBy("ticker").agg(*[
        F.coalesce(F.sum(F.when(F.col("frame") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in ("n_metrics", "n_valuation", "n_growth")])
    known = profiles.select("ticker", F.col("profile").alias("_profile"))
    return totals.join(known, "ticker", "left").select(
        "ticker", F.coalesce("_profile", F.lit(DEFAULT_PROFILE)).alias("profile"),
        "n_metrics", "n_valuation", "n_growth")


def without_data(requested: DataFrame, produced: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(
        produced.select("ticker"), "ticker", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def _write_counted(df: DataFrame, path: str, sort_columns: list[str]) -> int:
    """Write sorted by company (for row-group skipping) and count on the way."""
    seen = Observation()
    ordered = df.repartitionByRange(*sort_columns).sortWithinPartitions(*sort_columns)
    ordered.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def publish(frames: Mapping[str, DataFrame], requested: DataFrame, root: str, run_id: str,
            run_start: datetime, period: str = "quarterly") -> dict:
    """Write one run under ``root/run_id``; its manifest appears only when all is in place.

    A run directory is never rewritten.  Readers go through the manifest, so they see a
    complete run or none.
    """
    missing = [name for name in FRAMES if name not in frames]
    if missing:
        raise ValueError(f"frames missing from the run: {missing}")
    run = f"{root}/{run_id}"
    rows = {}
    for name in FRAMES:
        keys = [c for c in ("ticker", "concept", "end") if c in frames[name].columns]
        rows[name] = _write_counted(frames[name], f"{run}/{name}", keys)
    spark = requested.sparkSession
    zones = None
    for name in FRAMES:
        files = spark.read.parquet(f"{run}/{name}").groupBy(
            F.lit(name).alias("frame"), F.col("_metadata.file_path").alias("file")).agg(
            F.min("ticker").alias("least"), F.max("ticker").alias("greatest"))
        zones = files if zones is None else zones.unionByName(files)
    zones.coalesce(1).write.parquet(f"{run}/{ZONES}")
    produced = spark.read.parquet(f"{run}/universe")
    absent = without_data(requested, produced)
    absent.write.parquet(f"{run}/tickers_without_data")
    counts = requested.select("ticker").distinct().agg(F.count(F.lit(1)).alias("n")).first()
    manifest = {
        "schema": K.EXPORT_SCHEMA_VERSION,
        "run_id": run_id,
        "run_start": run_start.isoformat(timespec="seconds"),
        "exported_at": datetime.now().isoformat(timespec="seconds"),
        "period": period,
        "tickers_requested": counts["n"],
        "tickers_with_data": rows["universe"],
        "rows": rows,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(
        f"{run}/{MANIFEST}")
    return manifest


def read_manifest(spark: SparkSession, root: str, run_id: str) -> dict:
    line = spark.read.text(f"{root}/{run_id}/{MANIFEST}").first()
    if line is None:
        raise FileNotFoundError(f"run {run_id} has no manifest")
    return json.loads(line["value"])


def read_frame(spark: SparkSession, root: str, run_id: str, name: str,
               ticker: str | None = None) -> DataFrame:
    """A frame of a complete run; for one company only the files that can have it are opened."""
    manifest = read_manifest(spark, root, run_id)
    if set(FRAMES) - set(manifest["rows"]):
        raise FileNotFoundError(f"run {run_id} is incomplete")
    path = f"{root}/{run_id}/{name}"
    if ticker is None:
        return spark.read.parquet(path)
    # frames are in order of companies, so few files can have one
    zones = spark.read.parquet(f"{root}/{run_id}/{ZONES}").filter(
        (F.col("frame") == name) & (F.col("least") <= ticker) & (F.col("greatest") >= ticker))
    files = [row["file"] for row in zones.select("file").collect()]
    schema = spark.read.parquet(path).schema
    frame = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return frame.filter(F.col("ticker") == ticker)


def freshness(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Run date and how many companies have data, as one row."""
    m = read_manifest(spark, root, run_id)
    return spark.createDataFrame(
        [(m["run_id"], m["run_start"], m["exported_at"], m["tickers_requested"],
          m["tickers_with_data"])],
        "run_id string, run_start string, exported_at string, tickers_requested bigint, "
        "tickers_with_data bigint")
