"""Readers for filing documents and identifier files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck import constants as K
from quarterdeck import schemas

TICKER_IN_PATH = r"([^/]+?)(?:_company_info|_submissions)?\.json$"


def _ticker_from_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def flatten_company_facts(documents: DataFrame) -> DataFrame:
    """Nested ``facts -> us-gaap -> tag -> units -> unit -> items`` to one row per item.

    Positions in the document are kept because later rules break ties by first occurrence.
    No filter on the form is applied here.
    """
    tags = documents.select("ticker", F.explode("facts.us-gaap").alias("tag", "body"))
    units = tags.select("ticker", "tag",
                        F.posexplode(F.map_entries("body.units")).alias("unit_pos", "entry"))
    items = units.select("ticker", "tag", F.col("entry.key").alias("unit"), "unit_pos",
                         F.posexplode("entry.value").alias("ordinal", "item"))
    return items.select(
        "ticker", "tag", "unit", "unit_pos", "ordinal",
        F.to_date("item.start").alias("start"), F.to_date("item.end").alias("end"),
        "item.val", F.to_date("item.filed").alias("filed"), "item.fp", "item.fy", "item.form",
        "item.accn")


def parsed_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts(ticker, text)`` to readable documents (ticker, facts), and those that are not
    (ticker, text), which are set aside instead of failing the run or passing as empty.
    """
    schema = T.StructType([*schemas.COMPANY_FACTS_JSON.fields, T.StructField("_broken", T.StringType())])
    parsed = texts.withColumn("_document", F.from_json(
        "text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    sound = F.col("_document._broken").isNull() & F.col("_document.facts.us-gaap").isNotNull()
    return (parsed.filter(sound).select("ticker", "_document.facts"),
            parsed.filter(~F.coalesce(sound, F.lit(False))).select("ticker", "text"))


def read_documents(spark: SparkSession, path: str, ticker_pattern: str = TICKER_IN_PATH) -> DataFrame:
    """Documents as they are, one file per company: (ticker, text)."""
    return spark.read.text(path, wholetext=True).select(
        _ticker_from_path(ticker_pattern).alias("ticker"), F.col("value").alias("text"))


def read_company_facts(spark: SparkSession, path: str,
                       ticker_pattern: str = TICKER_IN_PATH) -> DataFrame:
    """Company-facts documents, one JSON file per company."""
    documents, _ = parsed_documents(read_documents(spark, path, ticker_pattern))
    return flatten_company_facts(documents)


def flatten_submissions(documents: DataFrame) -> DataFrame:
    recent = F.col("filings.recent")
    zipped = F.explode(F.arrays_zip(
        recent["form"].alias("form"), recent["reportDate"].alias("reportDate"),
        recent["filingDate"].alias("filingDate"))).alias("row")
    date = lambda c: F.to_date(F.nullif(F.col(c), F.lit("")))
    return documents.select("ticker", zipped).select(
        "ticker", F.col("row.form").alias("form"), date("row.reportDate").alias("report_date"),
        date("row.filingDate").alias("filing_date"))


def read_submissions(spark: SparkSession, path: str,
                     ticker_pattern: str = TICKER_IN_PATH) -> DataFrame:
    documents = (spark.read.schema(schemas.SUBMISSIONS_JSON).option("multiLine", True)
                 .json(path).select(_ticker_from_path(ticker_pattern).alias("ticker"), "filings"))
    return flatten_submissions(documents)


def identifier_map(entries: DataFrame, overrides: DataFrame | None = None,
                   min_entries: int = K.MIN_IDENTIFIER_ENTRIES) -> DataFrame:
    """``entries(ticker, cik_str)`` to zero-padded identifiers; overrides win.

    Of several identifiers the greatest number wins.  A file with implausibly few entries
    fails the job, where it runs, instead of yielding a thin universe.
    """
    padded = entries.groupBy("ticker").agg(
        F.lpad(F.max(F.col("cik_str").cast("long")).cast("string"), 10, "0").alias("cik"))
    found = entries.agg(F.count_distinct("ticker")).scalar()
    thin = F.raise_error(F.concat(F.lit("identifier file yields only "), found.cast("string"),
                                  F.lit(f" entries, fewer than {min_entries}")))
    padded = padded.withColumn("cik", F.when(found >= min_entries, F.col("cik")).otherwise(thin))
    if overrides is None:
        return padded
    wanted = overrides.select("ticker", F.col("cik").alias("_override"))
    return padded.join(wanted, "ticker", "full").select(
        "ticker", F.coalesce("_override", "cik").alias("cik"))


def override_audit(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Whether each override is still needed."""
    filed = entries.select("ticker", F.lpad(F.col("cik_str").cast("string"), 10, "0")
                           .alias("from_file"))
    return overrides.join(filed, "ticker", "left").select(
        "ticker", "cik", "from_file",
        F.when(F.col("from_file").isNull(), "absent")
        .when(F.col("from_file") == F.col("cik"), "REDUNDANT")
        .otherwise("CONTESTED").alias("status"))


def unresolved(requested: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Requested companies without an identifier: skipped and reported, not fatal."""
    return requested.select("ticker").join(identifiers, "ticker", "left_anti")


def search_tags(raw_facts: DataFrame, keywords: list[str]) -> DataFrame:
    """Distinct tags per company whose name contains any keyword, ignoring case."""
    words = F.array(*[F.lit(w.lower()) for w in keywords])
    hit = F.exists(words, lambda w: F.contains(F.lower("tag"), w))
    return raw_facts.filter(hit).select("ticker", "tag").distinct().orderBy("ticker", "tag")
