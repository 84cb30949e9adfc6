"""Near copies: texts whose sets of shingles have a Jaccard similarity of at least 0.8.

First come the pairs that op4's search has: SimHash fingerprints of the sets, found through its table
of distances to reference fingerprints.  Their links are verified on the sets.  Four bits do not reach
down to 0.8, so a second search finds what lies beyond; with it the result is exact.  Shingles have one order for the whole table, those frequent in a sample
of the texts last.  Two sets of a similarity s share one of the first n - ceil(s n) + 1 shingles
in that order, n being the size of either set; so these are the keys.  Up to the last key
that two sets share, all they have in common are shared keys, and behind it no more than the
smaller rest; pairs that this bound does not rule out are verified on the sets themselves.
Which shingles the sample holds changes the work, not the result.

A key shared by many near copies of one text would make all pairs of them.  So each member of
a key is first compared with one hub alone, the member with most shingles from the key on (an edited
copy has shingles of its own, which stand before it); then, with the components that these links and
the fingerprints' make, only pairs that are still in different components are compared.

Before whole sets are compared, a pair's bitmaps are: every shingle sets one of about four bits a
shingle, and a bit that only one set has stands for a shingle that the other lacks.  So
texts travel for pairs that are most likely links.  Members of a key that are still apart leave
its task as pairs where these are few for the members; only for the other keys do bitmaps travel to
the key, folded to a bounded length, and pairs that may be links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import simhash_dedup
from quarterdeck.llm.components import connected_components
from quarterdeck.llm.scratch import Scratch, whole_text
from quarterdeck.llm.simhash_dedup import SEED, majority, shingle_spans

WORDS = 5
SIMILARITY = 0.8
#: share of the texts in the sample, how often a shingle must occur there to count as frequent, and
#: how many frequent ones are sent to every task
SAMPLE = 0.25
OFTEN = 3
MOST_FREQUENT = 500_000
#: bits of the table that tells which doc_ids may be among those wanted
TABLE_BITS = 24
#: bits by which fingerprints that op4's search finds may differ
RADIUS = simhash_dedup.RADIUS
#: members of a key that are compared in one go, and pairs whose bitmaps are
CHUNK = 1024
PAIRS = 1 << 14
#: pairs that a key sends for each member before bitmaps come to it instead, and bytes of such a bitmap at most
PAIRS_A_MEMBER = 8
BITMAP_BYTES = 1 << 11


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, in order of the hash."""
    joined, starts, ends = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set: texts with equal sets are one node."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def bitmap_of(shingles: np.ndarray) -> bytes:
    """A power of two of bits, four for each shingle or more, by the low bits of the hashes."""
    size = max(8, 1 << int(4 * len(shingles)).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(one: bytes, n: int, two: bytes, m: int) -> int:
    """How many shingles two sets share at most, by their bitmaps; a longer one is folded."""
    if len(one) > len(two):
        one, n, two, m = two, m, one, n
    x, y, size = int.from_bytes(one, "little"), int.from_bytes(two, "little"), len(two) * 8
    while size > len(one) * 8:
        size //= 2
        y = y >> size | y & ((1 << size) - 1)
    return min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())


class Bitmaps:
    """Bitmaps of a key's members, by their length; compares many pairs at once."""

    def __init__(self, bits: np.ndarray):
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        self.row, self.tables = np.zeros(len(bits), np.int64), {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.row[own] = np.arange(len(own))
            self.tables[width] = np.frombuffer(b"".join(bits[own]), np.uint8).reshape(-1, width)

    def folded(self, members: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(members), width), np.uint8)
        for own in np.unique(self.width[members]).tolist():
            here = np.flatnonzero(self.width[members] == own)
            table = self.tables[own][self.row[members[here]]]
            while table.shape[1] > width:
                table = table[:, :table.shape[1] // 2] | table[:, table.shape[1] // 2:]
            out[here] = table
        return out.view(np.uint64) if width % 8 == 0 else out

    def most_shared(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """How many shingles the sets of members i and j, of n and m shingles, share at most."""
        most, widths = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(widths).tolist():
            same = np.flatnonzero(widths == width)
            for at in range(0, len(same), PAIRS):
                part = same[at:at + PAIRS]
                x, y = self.folded(i[part], width), self.folded(j[part], width)
                lone = [np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) for a, b in ((x, y), (y, x))]
                most[part] = np.minimum(n[part] - lone[0], m[part] - lone[1])
        return most


def required(sizes, similarity: float):
    """Shingles that sets of these sizes together share, at least."""
    return np.ceil(similarity * sizes / (1 + similarity) - 1e-9)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def least_shared(sizes: Column, similarity: float) -> Column:
    return F.ceil(F.lit(similarity) * sizes / F.lit(1 + similarity) - F.lit(1e-9))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in several texts of a sample of all, in order, and in how many: the most frequent, if many."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("near")), F.lit(1 << 20)) < int(SAMPLE * (1 << 20)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    found = sample.select(whole_text().alias("text")).mapInArrow(spell, "shingle long").groupBy("shingle").count().filter(
        F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toPandas()
    shingles, counts = found["shingle"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def with_keys(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, node, size, bitmap and fingerprint of its set, keys in order."""
    often, counts = frequent_shingles(docs, words)

    def keys(shingles: np.ndarray) -> np.ndarray:
        taken = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
        if len(often):
            at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
            shingles = shingles[np.argsort(np.where(often[at] == shingles, counts[at], 0), kind="stable")]
        return shingles[:taken].view(np.int64)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)),
                 pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap_of(s) for s in sets], pa.binary()),
                 pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                 pa.array([keys(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "node", "size", "bits", "fingerprint", "keys"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        spell, "doc_id long, node long, size int, bits binary, fingerprint long, keys array<long>")


def by_fingerprint(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes that op4's search links: each with the least of its fingerprint, and
    those with the nodes that links between fingerprints lead to."""
    prints = scratch.write(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    first = lambda side: prints.select(F.col("fingerprint").alias(side), F.col("first").alias(f"_{side}"))
    between = simhash_dedup.links(prints, prints.count(), radius).join(first("a"), "a").join(first("b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = nodes.select("fingerprint", "node").join(prints, "fingerprint").filter("first <> node").select(
        F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(same).filter("a <> b").select(*ordered("a", "b"))


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Bounds of the runs of equal keys in sorted batches, with the columns; no run is cut."""
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", *columns)]
        if rest is not None:
            now = [np.concatenate(pair) for pair in zip(rest, now)]
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(now[0])) + 1))
        rest = [c[bounds[-1]:] for c in now]
        if len(bounds) > 1:
            yield bounds, [c[:bounds[-1]] for c in now]
    if rest is not None and len(rest[0]):
        yield np.array([0, len(rest[0])]), rest


def may_reach(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of sets (size, place of a shared key) that the sizes and places do not rule out.

    Before the shared key stand at most min(at, bt) shared shingles, from it on no more than are left.
    """
    return np.minimum(at, bt) + np.minimum(n - at, m - bt) >= required(n + m, similarity)


def not_ruled_out(keyed: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of rows a, b, n, at, m, bt (one for each shared key) that the number
    of their shared keys and what is left behind the last one do not rule out."""
    both = keyed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), *[F.max(c).alias(c) for c in ("n", "at", "m", "bt")])
    return both.filter(F.col("shared") + F.least(F.expr("n - at"), F.expr("m - bt")) - 1
                       >= least_shared(F.expr("n + m"), similarity)).select("a", "b")


def shared_keys(prints: DataFrame) -> DataFrame:
    """key, node, size, place, of keys with several nodes, and a hub with its size and place: the node with
    most shingles from the key on."""
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, (key, node, size, place) in runs(batches, "node", "size", "place"):
            starts, lengths = bounds[:-1], np.diff(bounds)
            left = size - place  # rows are in order of key and node
            most = np.repeat(np.maximum.reduceat(left, starts), lengths)
            hubs = np.repeat(np.minimum.reduceat(np.where(left == most, np.arange(len(left)), len(left)), starts), lengths)
            several = np.repeat(node[starts] != node[starts + lengths - 1], lengths)
            kept = np.flatnonzero(several & np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))))
            hubs = hubs[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (key[kept], node[kept], size[kept], place[kept], node[hubs], size[hubs], place[hubs])],
                ["key", "node", "size", "place", "hub", "hub_size", "hub_place"])

    rows = prints.select("node", "size", F.posexplode("keys").alias("place", "key")).select("key", "node", "size", "place")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        members, "key long, node long, size int, place int, hub long, hub_size int, hub_place int")


def pairs_apart(a: int, b: int, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray,
                similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of members a to b of a key that have different roots and that sizes and places do not
    rule out, the lesser node first."""
    for left in range(a, b, CHUNK):
        x = slice(left, min(left + CHUNK, b))
        for right in range(left, b, CHUNK):
            y = slice(right, min(right + CHUNK, b))
            i, j = np.nonzero((root[x, None] != root[None, y]) & may_reach(
                size[x, None], place[x, None], size[None, y], place[None, y], similarity))
            if left == right:
                i, j = i[i < j], j[i < j]
            i, j = i + left, j + right
            if len(i):
                yield np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)


def few_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a key's members that have different roots and that sizes and places do not rule out,
    of keys with ``PAIRS_A_MEMBER`` of them for each member at most; of other keys, marked ``many``, the members:
    key, and as a, b, n, at their node, root, size and place."""
    kinds = (np.bool_, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
    names = ["many", "key", "a", "b", "n", "at", "m", "bt"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, (key, node, root, size, place) in runs(batches, "node", "root", "size", "place"):
            rows = []
            # a key whose members have one root has no pairs
            apart = np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1])
            for a, b in zip(bounds[:-1][apart].tolist(), bounds[1:][apart].tolist()):
                found, number, none = [], 0, np.zeros(b - a, np.int32)
                for i, j in pairs_apart(a, b, node, root, size, place, similarity):
                    number += len(i)
                    if number > PAIRS_A_MEMBER * (b - a):
                        own = slice(a, b)
                        found = [(none + 1, key[own], node[own], root[own], size[own], place[own], none, none)]
                        break
                    found.append((np.zeros(len(i)), key[i], node[i], node[j], size[i], place[i], size[j], place[j]))
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(zip(*rows), kinds)], names)

    return members.select("key", "node", "root", "size", "place").repartition("key").sortWithinPartitions(
        "key").mapInArrow(pairs, "many boolean, key long, a long, b long, n int, at int, m int, bt int")


def folded_bitmaps(nodes: DataFrame) -> DataFrame:
    """node and bits, bitmaps of more than ``BITMAP_BYTES`` folded to that length."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).to_pylist()
            for at, table in enumerate(bits):
                if len(table) > BITMAP_BYTES:
                    parts = np.frombuffer(table, np.uint8).reshape(-1, BITMAP_BYTES)
                    bits[at] = np.bitwise_or.reduce(parts, axis=0).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["node", "bits"])

    return nodes.select("node", "bits").mapInArrow(fold, "node long, bits binary")


def pairs_within(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a key's members that have different roots and are ruled out neither by sizes and
    places nor by their bitmaps."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, (key, node, root, size, place, bits) in runs(batches, "node", "root", "size", "place", "bits"):
            for a, b in zip(bounds, bounds[1:]):
                bitmaps = None
                for i, j in pairs_apart(a, b, node, root, size, place, similarity):
                    bitmaps = bitmaps or Bitmaps(bits[a:b])
                    n, m = size[i].astype(np.int64), size[j].astype(np.int64)
                    likely = np.flatnonzero(bitmaps.most_shared(i - a, j - a, n, m) >= required(n + m, similarity))
                    i, j = i[likely], j[likely]
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in (node[i], node[j], size[i], place[i], size[j], place[j])],
                            ["a", "b", "n", "at", "m", "bt"])

    return members.select("key", "node", "root", "size", "place", "bits").repartition("key").sortWithinPartitions(
        "key").mapInArrow(pairs, "a long, b long, n int, at int, m int, bt int")


def with_suspicion(rows: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``_suspect``: whether a row's doc_id may be one of ``ids`` (never null).

    The ids set bits of a table of 1 << TABLE_BITS bits, whatever their number; its words of 64
    bits are sent to every task.
    """
    place = lambda c: F.xxhash64(F.col(c).cast("long"), F.lit("wanted")).bitwiseAND((1 << TABLE_BITS) - 1)
    words = ids.select(place("doc_id").alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(_place & 63 AS INT)))").alias("_bits"))
    placed = rows.withColumn("_place", place(doc_id)).withColumn("_word", F.shiftright("_place", 6))
    hit = F.coalesce(F.expr("shiftrightunsigned(_bits, CAST(_place & 63 AS INT)) & 1 = 1"), F.lit(False))
    return placed.join(F.broadcast(words), "_word", "left").withColumn(
        "_suspect", hit & F.col(doc_id).isNotNull()).drop("_word", "_place", "_bits")


def among(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes without most of those that are not ``wanted``; nothing is shuffled for it."""
    return with_suspicion(nodes, wanted.select(F.col("node").alias("doc_id")), "node").filter("_suspect").drop("_suspect")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes that their bitmaps do not rule out."""
    nodes = among(nodes.select("node", "bits", "size"), pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            shared = np.fromiter(map(most_shared, batch.column("one").to_pylist(), n.tolist(),
                                     batch.column("two").to_pylist(), m.tolist()), np.int64, batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(shared >= required(n.astype(np.int64) + m, similarity)))

    side = lambda node, bits, size: nodes.select(
        F.col("node").alias(node), F.col("bits").alias(bits), F.col("size").alias(size))
    return pairs.join(side("a", "one", "n"), "a").join(side("b", "two", "m"), "b").mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float,
             scratch: Scratch, label: str) -> DataFrame:
    """The pairs of nodes that have the similarity, by their whole sets."""
    pairs = scratch.write(likely(pairs, nodes, similarity), f"{label}_likely")
    wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        nodes.select("node", "least_id"), "node").select(F.col("least_id").alias("doc_id")).distinct(), f"{label}_ids")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    texts = with_suspicion(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), wanted, "doc_id").filter(
        "_suspect").drop("_suspect").join(wanted, "doc_id", "left_semi")
    # a doc_id may have several texts, and rows may be repeated
    sets = scratch.write(texts.select("text").mapInArrow(spell, "node long, shingles array<long>").dropDuplicates(["node"]),
                         f"{label}_sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    needed = least_shared(F.size("one") + F.size("two"), similarity)
    links = scratch.write(both.filter(F.size(F.array_intersect("one", "two")) >= needed).select("a", "b"), f"{label}_links")
    for done in ("likely", "ids", "sets"):
        scratch.drop(f"{label}_{done}")
    return links


def ordered(one: str, two: str) -> tuple[Column, Column]:
    return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")


def classes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, node, component_id of every row with a doc_id."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    prints = scratch.write(with_keys(docs, words, similarity), "prints")
    nodes = scratch.write(prints.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits"),
        F.any_value("fingerprint").alias("fingerprint")), "nodes")
    shared = scratch.write(shared_keys(prints), "shared")
    # a node is first compared with those that op4's search finds and with one hub, that with which it
    # shares most keys; what this leaves out, and what the bound leaves out by counting a hub's own keys
    # alone, comes back below
    to_hub = shared.filter("node <> hub").groupBy(F.col("hub"), F.col("node")).agg(F.count(F.lit(1)).alias("n")).groupBy(
        "node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(*ordered("hub", "node"))
    tried = scratch.write(by_fingerprint(nodes, RADIUS, scratch).unionByName(to_hub).distinct(), "first_pairs")
    first = verified(tried, docs, nodes, words, similarity, scratch, "first")
    roots = scratch.write(connected_components(first), "roots")
    # then with its other hubs, as far as they are in other components
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    low = lambda of_hub, own: F.when(F.col("hub") < F.col("node"), F.col(of_hub)).otherwise(F.col(own))
    high = lambda of_hub, own: low(own, of_hub)
    apart = shared.filter("node <> hub").select(
        low("hub", "node").alias("a"), high("hub", "node").alias("b"), low("hub_size", "size").alias("n"),
        low("hub_place", "place").alias("at"), high("hub_size", "size").alias("m"),
        high("hub_place", "place").alias("bt")).join(root_of("a"), "a", "left").join(
        root_of("b"), "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)")
    hubs = scratch.write(not_ruled_out(apart, similarity).join(tried, ["a", "b"], "left_anti"), "hub_pairs")
    first = first.unionByName(verified(hubs, docs, nodes, words, similarity, scratch, "hub"))
    tried = tried.unionByName(hubs)
    roots = scratch.write(connected_components(first), "roots_of_hubs")
    rooted = shared.select("key", "node", "size", "place").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    few = scratch.write(few_pairs(rooted, similarity), "few_pairs", "many")
    many = few.filter("many").selectExpr("key", "a AS node", "b AS root", "n AS size", "at AS place")
    members = many.join(folded_bitmaps(among(nodes.select("node", "bits"), many)), "node")
    # a pair may share keys of both kinds
    keyed = few.filter("NOT many").select("a", "b", "n", "at", "m", "bt").unionByName(pairs_within(members, similarity))
    others = scratch.write(not_ruled_out(keyed, similarity).join(tried, ["a", "b"], "left_anti"), "second_pairs")
    scratch.drop("shared")
    scratch.drop("few_pairs")
    second = verified(others, docs, nodes, words, similarity, scratch, "second")
    scratch.drop("second_pairs")
    roots = connected_components(first.unionByName(second))
    rooted = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = rooted.join(least, "root").select("node", "component_id")
    return prints.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", "component_id")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with a doc_id: doc_id, component_id.

    Documents are linked where the Jaccard similarity of their sets of ``words``-word shingles
    is ``similarity`` or more (words as in op4: between white space, A-Z lowered; a shorter
    text is one shingle); component_id is the smallest doc_id that links reach.  Null texts
    count as empty; texts without words are equal.
    """
    return classes(docs, words, similarity).select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id; all columns.

    Null texts count as empty, texts without words are equal, rows repeated with one doc_id go or
    stay together, and of several texts with one doc_id each is judged by itself.  Documents
    without a doc_id stay.  An empty table gives an empty one; columns may have any names.  A
    text is spelt by one task, whatever its length.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "dropped")
    dropped = scratch.write(classes(docs, words, similarity).filter("component_id <> doc_id").select(
        F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct(), "nodes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                       whole_text().alias("_text"))
    marked = with_suspicion(rows, dropped.select(F.col("_id").alias("doc_id")), "_id")

    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(shingle_set(t, words)) for t in texts], dtype="uint64").to_numpy().view(np.int64)

    node = F.pandas_udf(lambda texts: pd.Series(nodes(texts)), "long")
    kept = marked.filter(F.col("_suspect")).withColumn("_node", node("_text")).join(dropped, ["_id", "_node"], "left_anti")
    return marked.filter(~F.col("_suspect")).select("_row").unionByName(kept.select("_row")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names])
