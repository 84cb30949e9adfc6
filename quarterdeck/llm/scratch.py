"""Intermediate tables in the cluster's shared folder, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder (tests); on a
    cluster, where executors share no local disk, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must be set")
    folder = tempfile.mkdtemp(prefix="quarterdeck-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one run of an operator: written as Parquet, read back without lineage.

    A table stays until ``drop``; what the operator returns may still read the others, so
    they are cleaned up with the checkpoint folder, as checkpoints are.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str, *partitions: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole_text(column: str = "text") -> Column:
    """A text where null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
