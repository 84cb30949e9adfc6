"""Sharding by extendible hashing.

A document's hash is read bit by bit.  A bucket, that is a prefix of bits, whose documents
exceed the byte limit is split on the next bit; all others stay as they are.  The directory
lists the buckets that are left, with prefixes of different lengths.

Sizes are first summed by prefixes long enough for nearly every bucket to fit, map-side, and
rolled up from there; prefixes that still exceed the limit are split further, in rounds.  The
hash covers doc_id, text and the number among equal rows, so rows that share a doc_id are split
like any others and every run, however the files are cut, gives the same shards.  The directory
is a table and never passes through the driver.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch, whole_text

LIMIT = 64 << 20
#: bits read at a time beyond those that an even spread would need
SLACK_BITS = 6
MOST_BITS = 62
#: equal rows that are numbered at a time
RUN = 1 << 16


def bits(depth) -> F.Column:
    """The first ``depth`` bits of the hash, as a number."""
    return F.expr(f"shiftrightunsigned(code, 64 - {depth})") if isinstance(depth, int) else depth


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``code``, one row per document; equal rows are counted, then numbered in runs."""
    text = whole_text()
    equal = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("digest")).groupBy(
        "doc_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("times"))
    runs = equal.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition("doc_id", "digest", "first")
    last = F.least(F.col("first") + RUN, "times") - 1
    return runs.withColumn("number", F.explode(F.sequence("first", last))).select(
        "doc_id", "n_bytes", F.xxhash64("doc_id", "digest", "number").alias("code"))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, shard_bits, shard_bytes, shard_docs.

    ``shard`` is the bucket's prefix in binary ('' if all documents fit one shard).  Null
    texts count as empty.  A document larger than the limit gets a shard of its own, named
    'large-' and its hash, and so do those that share ``MOST_BITS`` bits and exceed it together; no other
    shard exceeds the limit.  Rows repeated with one doc_id are placed one by one.  An empty
    table gives an empty result; a text of any length counts whole.  Other columns are ignored.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.write(numbered(docs), "rows")
    fitting = rows.filter(F.col("n_bytes") <= limit)
    total = fitting.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(MOST_BITS, ceil(log2(max(1, total / limit))) + SLACK_BITS)
    directory, level, open_rows = None, 0, fitting
    below = 0  # prefixes up to this depth are known to exceed the limit
    while True:
        cells = open_rows.groupBy(bits(depth).alias("cell") if depth else F.lit(0).cast("long").alias("cell")).agg(
            F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
        # every prefix between the two depths, with its size
        rolled = cells.withColumn("shard_bits", F.explode(F.sequence(F.lit(below), F.lit(depth)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - shard_bits)"))
        sized = rolled.groupBy("shard_bits", "prefix").agg(
            F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_docs").alias("shard_docs"))
        fits = sized.filter(F.col("shard_bytes") <= limit)
        parent = sized.filter(F.col("shard_bytes") > limit).select(
            (F.col("shard_bits") + 1).alias("shard_bits"), F.col("prefix").alias("above"))
        split = fits.withColumn("above", F.shiftright("prefix", 1)).join(parent, ["shard_bits", "above"], "left_semi")
        first = fits.filter(F.col("shard_bits") == below) if below == 0 else fits.limit(0)
        found = scratch.write(split.drop("above").unionByName(first), f"directory{level}")
        directory = found if directory is None else directory.unionByName(found)
        too_large = sized.filter((F.col("shard_bits") == depth) & (F.col("shard_bytes") > limit)).select(
            F.col("prefix").alias("cell"))
        too_large = scratch.write(too_large, f"open{level}")
        if depth >= MOST_BITS or too_large.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", bits(depth)).join(too_large, "cell", "left_semi").drop("cell")
        below, depth, level = depth, min(MOST_BITS, depth + SLACK_BITS), level + 1
    name = F.when(F.col("shard_bits") == 0, "").otherwise(F.expr("lpad(bin(prefix), shard_bits, '0')"))
    named = directory.withColumn("shard", name)
    depths = [r["shard_bits"] for r in named.select("shard_bits").distinct().collect()]  # at most 63
    # a document has one prefix in the directory: look it up under each depth that occurs
    probed = fitting.withColumn("probe", F.explode(F.array(*[
        F.struct(F.lit(d).alias("shard_bits"), (bits(d) if d else F.lit(0).cast("long")).alias("prefix"))
        for d in depths]))) if depths else fitting.withColumn(
        "probe", F.struct(F.lit(0).alias("shard_bits"), F.lit(0).cast("long").alias("prefix"))).limit(0)
    placed = probed.select("doc_id", "n_bytes", "probe.*").join(named, ["shard_bits", "prefix"]).select(
        "doc_id", "n_bytes", "shard", "shard_bits", "shard_bytes", "shard_docs")
    # what all bits leave together joins the large ones
    alone = rows.filter(F.col("n_bytes") > limit).unionByName(
        fitting.withColumn("cell", bits(depth) if depth else F.lit(0).cast("long")).join(too_large, "cell", "left_semi").drop("cell"))
    large = alone.select(
        "doc_id", "n_bytes", F.concat(F.lit("large-"), F.hex("code")).alias("shard"), F.lit(MOST_BITS + 2).alias("shard_bits"),
        F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"))
    return placed.unionByName(large)
