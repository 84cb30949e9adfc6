"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by their leading bytes, then by the bytes that follow, until a group holds
one text only or its texts have ended.  A round takes the next ``width`` bytes of every text
that is still in a group of two or more; widths grow, so that a text of n bytes takes about
log(n) rounds.  Groups are compared by the bytes themselves, never by a digest.

Counting a round's groups combines map-side, so a group with a third of all rows reaches a
reducer as one row per task.  A row learns its group through an equi-join whose large side
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import BLANKS, Scratch, whole_text

FIRST_WIDTH = 48
GROWTH = 8


def normalised(column: str = "text") -> Column:
    """Runs of ASCII white space become one space; nothing is trimmed."""
    return F.regexp_replace(whole_text(column), BLANKS, " ")


def radix_groups(rows: DataFrame, keep_text: bool = False, first_width: int = FIRST_WIDTH) -> DataFrame:
    """Group ``rows`` (doc_id, text, and one narrow column ``carried``) by equal normalised bytes.

    Returns doc_id, carried, row_id, group_id (row_id of one member), keep_id (smallest
    doc_id of the group), group_size, and text if it is to be kept.  ``rows`` must come in
    the same order whenever it is read (a table scan does).
    """
    scratch = Scratch(rows.sparkSession, "radix")
    alive = rows.select("doc_id", "carried", F.monotonically_increasing_id().alias("row_id"),
                        F.lit(0).cast("long").alias("parent"), "text")
    finished, start, width, level = None, 1, first_width, 0
    while True:
        split = alive.withColumn("head", F.substring(normalised().cast("binary"), start, width))
        groups = split.groupBy("parent", "head").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
            F.min("row_id").alias("first_row")).filter("n > 1")
        # a head shorter than the width has ended; texts that end with a full head do so in
        # the next round, as an empty head
        done = F.col("n").isNull() | (F.length("head") < width)
        routed = split.join(groups, ["parent", "head"], "left").select(
            "doc_id", "carried", "row_id", F.coalesce("first_row", "row_id").alias("parent"),
            F.coalesce("first_id", "doc_id").alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            F.when(~done | F.lit(keep_text), F.col("text")).alias("text"), done.alias("done"))
        table = scratch.write(routed, f"round{level}", "done")
        ended = table.filter("done").select(
            "doc_id", "carried", "row_id", F.col("parent").alias("group_id"), "keep_id", "group_size",
            *(["text"] if keep_text else []))
        finished = ended if finished is None else finished.unionByName(ended)
        alive = table.filter("NOT done").select("doc_id", "carried", "row_id", "parent", "text")
        if alive.isEmpty():
            return finished
        start, width, level = start + width, width * GROWTH, level + 1


def with_kept(grouped: DataFrame) -> DataFrame:
    """Add ``kept``: true in one row of each group, a row with the group's keep_id."""
    copies = grouped.filter("group_size > 1")
    # several rows may share that doc_id: the first of them
    stays = copies.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("group_id").agg(
        F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("stays"))
    marked = copies.join(stays, "row_id", "left").withColumn("kept", F.coalesce("stays", F.lit(False)))
    return grouped.filter("group_size = 1").withColumn("kept", F.lit(True)).unionByName(marked.drop("stays"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``; the row with the smallest doc_id
    of a group stays.  A null text counts as empty; a row without doc_id stays only where
    its whole group has none.  Of rows repeated with the same doc_id and text exactly one is
    kept.  Columns other than doc_id and text are ignored.  An empty table gives an empty
    result.
    """
    digest = F.sha2(normalised().cast("binary"), 256)
    grouped = radix_groups(docs.select("doc_id", digest.alias("carried"), "text"))
    return with_kept(grouped).select("doc_id", "keep_id", "group_size", "kept",
                                     F.col("carried").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns as they were."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    kept = with_kept(radix_groups(docs.select("doc_id", packed.alias("carried"), "text"), keep_text=True)).filter("kept")
    return kept.select(*[F.col(f"carried.`{c}`") if c in others else F.col(c) for c in docs.columns])
