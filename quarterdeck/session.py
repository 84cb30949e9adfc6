"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins on (ticker, end) may reuse a hash distribution on ticker alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: rows of a file behind a cut; a task reads about 30 of them (spark.sql.files.openCostInBytes)
ROWS_PER_FILE = 1 << 16

#: rows of a task that sorts long rows for windows, about
TASK_ROWS = 1 << 19


def build_session(app_name: str = "quarterdeck", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, or its context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder (tests); on a cluster,
    whose executors share no local disk, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quarterdeck-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, as Parquet in the cluster's shared folder.

    The files survive the loss of an executor, so later stages never recompute what is behind
    the cut, and readers take only the columns they need.  A file has ``ROWS_PER_FILE`` rows at
    most and a reader's task a bounded number of files, so a frame that grew out of few rows
    is dealt over tasks by its own size.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that both sides travel to.

    A cut is judged by its compressed bytes, behind which rows of few distinct values take hundreds of times as much;
    the driver would build the whole table of a side that grows with the companies.
    """
    return df.hint("merge")


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over as many tasks as ``rows`` rows need.

    Adaptive execution would join partitions up to a number of compressed bytes, behind which a task's sorts
    and windows take gigabytes.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)
