"""Quality by importance resampling.

Two bag models of hashed words and word pairs are estimated, one from labelled good texts (the target), one
from all texts (raw).  A document's weight is the log-ratio of its likelihoods, per n-gram;
documents are then sampled without replacement in proportion to their weights by adding
Gumbel noise and taking the k greatest.

The raw model counts every n-gram of every document.  k is the share of good texts among the
labelled ones, of all documents.  The k-th greatest key is found by counting keys by their
leading bits, sixteen at a time, so no ranking passes through one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch, whole_text

BUCKETS = 1 << 15
#: labelled good texts that the target model reads, at most (those least by a hash)
TARGET_SAMPLE = 8000
#: log-ratios are multiplied by so many n-grams, whatever a text's length: longer texts are no
#: better, and the noise must not drown the ratio
EFFECTIVE_NGRAMS = 100
SMOOTHING = 1.0
SEED = "gumbel"
WORD = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 200_000


def bucketer():
    """Text -> buckets of its words and word pairs."""
    known: dict[str, int] = {}

    def buckets(text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        for w in set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
            known[w] = zlib.crc32(w.encode("utf-8", "replace"))
        if len(known) > REMEMBERED:
            known.clear()
            known.update((w, zlib.crc32(w.encode("utf-8", "replace"))) for w in set(words))
        codes = np.fromiter((known[w] if w in known else zlib.crc32(w.encode("utf-8", "replace")) for w in words),
                            np.uint64, len(words))
        pairs = (codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)
        return (np.concatenate((codes, pairs)) % np.uint64(BUCKETS)).astype(np.int64)

    return buckets


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``texts``; a task sends one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = bucketer(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(buckets(text), minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE) -> tuple[np.ndarray, float]:
    """Log-ratio of target to raw probability per bucket, and the share of good labels."""
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL").filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    texts = docs.select("doc_id", whole_text().alias("text"))
    raw = bucket_counts(texts)
    if not share:
        return np.zeros(BUCKETS), 1.0 if share is None else 0.0
    good = known.filter("quality = 1").orderBy(F.xxhash64("doc_id", F.lit("target")), "doc_id").limit(sample)
    ids = spark.createDataFrame(good.select("doc_id").toPandas())
    target = bucket_counts(texts.join(F.broadcast(ids), "doc_id"))
    shares = [(c + SMOOTHING * raw / max(1, raw.sum()) * BUCKETS + 1e-9) for c in (target, raw)]
    return np.log(shares[0] / shares[0].sum()) - np.log(shares[1] / shares[1].sum()), float(share)


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order, from 0 on."""
    def bits(values: pd.Series) -> pd.Series:
        raw = values.to_numpy(np.float64).view(np.int64)
        return pd.Series(np.where(raw < 0, ~raw, raw ^ np.int64(-2 ** 63)).view(np.uint64) >> np.uint64(1)).astype("int64")

    return F.pandas_udf(bits, "long")(value)


def kth_greatest(keys: DataFrame, k: int) -> int:
    """The k-th greatest of the non-negative longs in column ``key``, by counts of 16 leading bits at a time."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        within = keys.filter(F.shiftright("key", shift + 16) == prefix) if shift < 48 else keys
        digit = F.shiftright("key", shift).bitwiseAND(0xFFFF).alias("digit")
        for row in sorted(within.groupBy(digit).count().collect(), key=lambda r: -r["digit"]):
            if k <= row["count"]:
                prefix = prefix << 16 | row["digit"]
                break
            k -= row["count"]
    return prefix


def quality(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE, share: float | None = None) -> DataFrame:
    """One row per document: doc_id, log_weight, sample_key, kept.

    ``kept`` marks the k documents with the greatest keys, k being ``share`` (or the share of
    good labels) of all, rounded up; equal keys at the border are all kept.  Null and empty
    texts have a weight of zero, as if drawn like the corpus.  A row labelled both ways counts
    as not good; without labels all are kept.  Rows repeated with one doc_id draw the same
    noise and so go together.
    """
    ratios, good = log_ratios(docs, labels, sample)
    share = good if share is None else share

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = bucketer()
        for batch in batches:
            found = [buckets(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(ratios[b].mean()) if len(b) else 0.0 for b in found])],
                ["doc_id", "log_weight"])

    weighed = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        weigh, "doc_id long, log_weight double")
    # uniform in (0, 1) from the doc_id
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("sample_key", F.col("log_weight") * EFFECTIVE_NGRAMS - F.log(-F.log(uniform)))
    keyed = Scratch(docs.sparkSession, "quality").write(keyed.withColumn("key", ordered_bits(F.col("sample_key"))), "keys")
    total = keyed.count()
    k = min(total, int(np.ceil(share * total)))
    border = kth_greatest(keyed, k) if k else 1 << 63
    kept = F.col("key") >= border if k else F.lit(False)
    return keyed.select("doc_id", "log_weight", "sample_key", kept.alias("kept"))
