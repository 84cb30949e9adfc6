"""Collocations by dynamic itemset counting of phrases.

The corpus is dealt over shards that are scanned in turn, again and again.  All lengths are
counted in the same scans: single words from the first scan on, a longer phrase from the scan
after both of its subphrases (without its last, without its first word) have reached the
threshold in what was counted so far, until it has completed one full cycle.  Scans end when no
phrase is still being counted.

Which phrases have reached the threshold, and in which scan, is told to the tasks as a table
of ``1 << TABLE_BITS`` bytes, addressed by a phrase's hash; its size does not depend on the
corpus.  Phrases that share an entry are counted though they need not be, so a full table costs
work and no results.  A last scan takes the whole counts of the phrases in the table, and one
block that has a phrase spells it.  Phrases are counted by 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm import token_blocks as tb
from quarterdeck.llm.scratch import Scratch, whole_text

LONGEST = 5
THRESHOLD = 100
SHARDS = 2
TABLE_BITS = 24
NEVER = 255
TOP = 2000
#: words that a task numbers before it writes its blocks, one per language
BLOCK_WORDS = 2 * tb.BLOCK_WORDS
BREAK = 0
#: phrase ends become line feeds, tabs become spaces, A-Z become a-z
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("shard", pa.int64()), ("n", pa.int64()),
                   ("n_tokens", pa.int64()), ("tokens", pa.binary()), ("word_bytes", pa.int64()), ("words", pa.binary())])
COUNTED = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BEGUN = pa.schema([*COUNTED, ("began", pa.int64())])
JUDGED = pa.schema([*BEGUN, ("entry", pa.int64())])


def to_blocks(docs: DataFrame, block_words: int, shards: int) -> DataFrame:
    """Texts as word numbers, ``BREAK`` between pieces; a block is of one language and shard."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, tuple[tb.Numbers, list[np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for lang, (words, parts) in open_blocks.items():
                tokens, block = np.concatenate(parts), tb.new_block()
                listed = list(words)[1:]  # without the break
                rows.append({"block": block, "lang": lang, "shard": block % shards, "n": int((tokens != BREAK).sum()),
                             "n_tokens": len(tokens), "tokens": tb.packed(tokens),
                             "word_bytes": sum(map(len, listed)) + max(0, len(listed) - 1), "words": tb.packed_words(listed)})
            return pa.RecordBatch.from_pylist(rows, BLOCK)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = text.encode("utf-8", "surrogatepass").translate(PLAIN).replace(b"\n", b" \n ")
                if lang not in open_blocks:
                    words = tb.Numbers(1)
                    words[b"\n"] = BREAK
                    words.first = 0
                    open_blocks[lang] = words, []
                words, parts = open_blocks[lang]
                found = words.of([w for w in plain.split(b" ") if w])
                parts.append(np.append(found, np.int32(BREAK)))
                size += len(found) + 1
                if size >= block_words:
                    yield flush()
                    open_blocks, size = {}, 0
        if open_blocks:
            yield flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       whole_text().alias("text")).mapInArrow(number, tb.ddl(BLOCK))


class Phrases:
    """The phrases of a block whose subphrases are all in the table, by length."""

    def __init__(self, block: dict, table: bytes):
        self.since = np.frombuffer(pa.decompress(table, 1 << TABLE_BITS, codec="zstd"), np.uint8)
        self.tokens = tb.unpacked(block["tokens"], block["n_tokens"], np.int32)
        self.words = [b"\n", *tb.unpacked_words(block["words"], block["word_bytes"])]
        self.hashes = tb.word_keys(self.words, block["lang"].encode("utf-8", "surrogatepass") + b"\n")

    def entry(self, keys: np.ndarray) -> np.ndarray:
        return self.since[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]

    def lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, first positions, keys, and from which scan on each is counted."""
        at = np.flatnonzero(self.tokens != BREAK)
        keys = self.hashes[self.tokens[at]]
        start = np.zeros(len(at), np.uint8)
        for n in range(1, longest + 1):
            yield n, at, keys, start
            reached = self.entry(keys)
            kept = np.flatnonzero(reached < NEVER)
            # a subphrase whose entry another took early is itself under way no earlier than its own subphrases
            at, keys, reached = at[kept], keys[kept], np.maximum(reached[kept], start[kept])
            both = np.flatnonzero(at[1:] == at[:-1] + 1)
            start = np.maximum(reached[both], reached[both + 1])
            at = at[both]
            keys = tb.longer_keys(keys[both], self.hashes[self.tokens[at + n]])


def compressed(since: np.ndarray) -> bytes:
    """The table as it travels with a task's code: of few entries, it takes few bytes; never more than all of it."""
    return pa.compress(since.tobytes(), codec="zstd", asbytes=True)


def counted(blocks: DataFrame, since: np.ndarray, scan: int, shards: int, longest: int, buckets: int) -> DataFrame:
    """Counts of the phrases that are under way in this scan, by bucket of length and key."""
    table = compressed(since)

    def count(block: dict) -> Iterator[dict]:
        for n, _, keys, start in Phrases(block, table).lengths(longest):
            for began in range(max(0, scan - shards + 1), scan + 1):
                for bucket, size, sent, number in tb.deal(*np.unique(keys[start == began], return_counts=True), buckets):
                    yield {"bucket": n * buckets + bucket, "n": size, "keys": sent, "counts": number, "began": began}

    return tb.map_blocks(blocks, count, BEGUN)


def judged(rows: DataFrame, threshold: int, scan: int, shards: int, buckets: int) -> DataFrame:
    """By bucket, what the counts add up to: for phrases that reach the threshold their table entries with the lengths
    (``entry`` is not null), and the sums of the others that are still under way in the next scan, packed as they came."""

    def add(sent: pa.Table) -> pa.Table:
        came = sent.to_pydict()
        bucket = came["bucket"][0]
        distinct, sums, place = tb.added_up(came["n"], came["keys"], came["counts"])
        began = np.zeros(len(distinct), np.int64)
        began[place] = np.repeat(np.array(came["began"]), came["n"])
        enough = sums >= threshold
        entries = np.unique(distinct[enough] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        none = np.full(len(entries), None)
        tables = [pa.Table.from_arrays([pa.array(c, field.type) for c, field in zip((
            np.full(len(entries), bucket), np.full(len(entries), bucket // buckets), none, none, none, entries), JUDGED)], schema=JUDGED)]
        # a phrase that began a cycle ago is done; one that has reached the threshold is in the table
        for first in range(max(0, scan + 2 - shards), scan + 1):
            own = np.flatnonzero(~enough & (began == first))
            for _, size, keys, counts in tb.deal(distinct[own], sums[own], 1):
                tables.append(pa.Table.from_pylist([{"bucket": bucket, "n": size, "keys": keys, "counts": counts,
                                                     "began": first, "entry": None}], JUDGED))
        return pa.concat_tables(tables)

    return rows.groupBy("bucket").applyInArrow(add, tb.ddl(JUDGED))


def find_phrases(blocks: DataFrame, scratch: Scratch, words: int, threshold: int, shards: int, longest: int) -> np.ndarray:
    """The table: by hash of a phrase the first scan after it had reached the threshold.

    A block's counts are dealt over buckets once; of phrases under way the next scan gets a bucket's sums.
    """
    since = np.full(1 << TABLE_BITS, NEVER, np.uint8)
    buckets, under_way, last, scan = tb.bucket_count(words), None, 0, 0
    while scan < last + shards:
        if scan == NEVER - shards:
            raise ValueError("too many shards")
        rows = counted(blocks.filter(F.col("shard") == scan % shards), since, scan, shards, longest, buckets)
        if under_way is not None:
            rows = rows.unionByName(under_way)
        told = scratch.write(judged(rows, threshold, scan, shards, buckets), f"scan{scan}")
        if scan:
            scratch.drop(f"scan{scan - 1}")
        under_way = told.filter("entry IS NULL").drop("entry")
        # 1 << TABLE_BITS entries at most
        found = told.filter("entry IS NOT NULL").select("n", "entry").distinct().toPandas()
        entries = found.entry.to_numpy(np.int64)
        since[entries[since[entries] == NEVER]] = scan + 1
        # what may go on in longer phrases is counted for a whole cycle, also where the longest took its entry first
        last = max(last, int(since[entries[found.n.to_numpy() < longest]].max(initial=0)))
        scan += 1
    if scan:
        scratch.drop(f"scan{scan - 1}")
    return since


CLOSING = pa.schema([*COUNTED, ("block", pa.int64())])
PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int64()), ("a", pa.int64())])


def whole_counts(blocks: DataFrame, since: np.ndarray, threshold: int, longest: int, buckets: int) -> DataFrame:
    """Phrases that occur ``threshold`` times or more, by one block that has them, as packed keys and counts."""
    table = compressed(since)

    def count(block: dict) -> Iterator[dict]:
        phrases = Phrases(block, table)
        for n, _, keys, _ in phrases.lengths(longest):
            there = keys[phrases.entry(keys) < NEVER]
            for bucket, size, sent, number in tb.deal(*np.unique(there, return_counts=True), buckets):
                yield {"bucket": n * buckets + bucket, "n": size, "keys": sent, "counts": number, "block": block["block"]}

    def add(sent: pa.Table) -> pa.Table:
        rows = sent.to_pydict()
        distinct, sums, place = tb.added_up(rows["n"], rows["keys"], rows["counts"])
        owner = np.zeros(len(distinct), np.int64)
        owner[place] = np.repeat(np.array(rows["block"]), rows["n"])
        found = []
        frequent = np.flatnonzero(sums >= threshold)
        for block in np.unique(owner[frequent]).tolist():
            own = frequent[owner[frequent] == block]
            _, size, keys, counts = next(tb.deal(distinct[own], sums[own], 1))
            found.append({"bucket": rows["bucket"][0] // buckets, "n": size, "keys": keys, "counts": counts, "block": block})
        return pa.Table.from_pylist(found, CLOSING)

    return tb.map_blocks(blocks, count, CLOSING).groupBy("bucket").applyInArrow(add, tb.ddl(CLOSING))


def spelt(blocks: DataFrame, counts: DataFrame, since: np.ndarray, longest: int) -> DataFrame:
    """lang, phrase, size, a of the phrases in ``counts``."""
    table = compressed(since)

    def spell(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        found, asked = [], wanted.to_pylist()
        for block in mine.to_pylist() if asked else []:
            phrases = Phrases(block, table)
            tokens = phrases.tokens
            for n, at, keys, _ in phrases.lengths(longest):
                distinct, first = np.unique(keys, return_index=True)
                for row in asked:
                    if row["bucket"] == n:
                        places = at[first[np.searchsorted(distinct, tb.dealt_keys(row["keys"], row["n"]))]]
                        for place, a in zip(places.tolist(), tb.unpacked(row["counts"], row["n"], tb.COUNT).tolist()):
                            text = b" ".join(phrases.words[t] for t in tokens[place:place + n])
                            found.append({"lang": block["lang"], "phrase": text.decode("utf-8", "replace"), "size": n, "a": a})
        return pa.Table.from_pylist(found, PHRASES)

    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(spell, tb.ddl(PHRASES))


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """The lowest-scoring cut of every phrase of two words or more: lang, phrase, size, a, l, r, n, score."""
    words = F.split("phrase", " ", -1)
    cuts = counts.filter(F.col("size") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)))
    cuts = cuts.withColumns({"left": part(words, F.lit(1), F.col("k")),
                             "right": part(words, F.col("k") + 1, F.col("size").cast("int") - F.col("k"))})
    side = lambda phrase, count: counts.select(
        "lang", F.col("phrase").alias(phrase), F.col("a").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(
        totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("below", (exact("l") * exact("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best.alias("best")).select(
        "lang", "phrase", "size", "a", "best.*")


def without_parts(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates but those inside a longer one that has ``share`` per cent of their occurrences or more."""
    words = F.split("phrase", " ", -1)
    size = F.col("size").cast("int")
    inside = candidates.filter(size > 2).select("lang", words.alias("words"), size.alias("size"), F.col("a").alias("longer"))
    inside = inside.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    most = inside.groupBy("lang", part(F.col("words"), F.col("start"), F.col("length")).alias("phrase")).agg(
        F.max("longer").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= share * F.col("a"), F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~covered).drop("longer")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int | None = TOP, longest: int = LONGEST,
                 share: int = 100, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The highest-scoring phrases per language: lang, rank, phrase, a, l, r, n, score.

    ``score`` is floor(1000 * a * n / (l * r)) of a phrase's lowest-scoring cut, in exact decimals.
    ``top`` ranks per language are reported, the feature of this report; None reports all.  Null
    texts count as empty, a null language as ``und``; repeated rows count each time; phrases do
    not cross pieces, texts or languages.  An empty table, or one in which no phrase reaches the
    threshold, gives an empty result.  Other columns of ``docs`` are not read.  A text is numbered by
    one task, whatever its length.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    blocks = scratch.write(to_blocks(docs, block_words, shards), "blocks", "shard")
    words = tb.total(blocks, "n")
    since = find_phrases(blocks, scratch, words, threshold, shards, longest)
    counts = scratch.write(whole_counts(blocks, since, threshold, longest, tb.bucket_count(words)), "counts")
    counts = scratch.write(spelt(blocks, counts, since, longest), "phrases")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = without_parts(scored(counts, totals, longest), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
