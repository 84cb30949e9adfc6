"""SimHash near-duplicates through a table of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a fixed set of references.  By the
triangle inequality two fingerprints within radius r differ by at most r in every
coordinate of that table, so a pair with a greater difference is discarded unseen.

References drawn at random lie 32 +- 4 bits from everything; they discard, but cannot address.
The table therefore starts with the origin and one reference per block of two bits: the
distance to a block's reference less the distance to the origin depends on that block alone.
A pair within r bits differs in at most r blocks.  With the blocks dealt into m slices, some
m - r slices have equal coordinates; each choice of m - r slices is a key, and only
fingerprints that share a key are compared.  m follows from the number of distinct
fingerprints, so that a key is shared by a few hundred unrelated ones at any size; the links
found are the same for each m.

Inside a key, links are found by search from one fingerprint to the next, so that a dense
group is left after about as many steps as it has members, and only the edges of a spanning
forest are written.  Larger keys are split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.components import connected_components
from quarterdeck.llm.scratch import Scratch, whole_text

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
BLOCK = 2
#: unrelated fingerprints that share a key, at most (the mean)
KEY_LOAD = 1024
#: fingerprints compared in one go; keys with more are split into pairs of chunks
CHUNK = 8192
#: up to so many, all pairs of a key are looked at as one matrix; beyond, one row at a time
MATRIX = 2048
#: references of the table that are tried on every pair before the others
FIRST_REFERENCES = 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: origin, then one reference per block
BLOCK_REFERENCES = np.array([0] + [((1 << BLOCK) - 1) << at for at in range(0, BITS, BLOCK)], np.uint64)
#: further references (multiples of an odd number close to 2^64 over the golden ratio)
SPREAD_REFERENCES = (np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_spans(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The text with A-Z lowered and words joined by one space; starts and ends of its shingles."""
    parts = text.encode("utf-8", "replace").translate(LOWER).split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return joined, [0] * bool(parts), [len(joined)] * bool(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist()


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    joined, starts, ends = shingle_spans(text, words)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long)."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        prints, "doc_id long, fingerprint long")


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Table of Hamming distances, one row per fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :])


def slices_for(count: int, radius: int = RADIUS) -> int:
    """Number of slices with which a key is shared by KEY_LOAD unrelated fingerprints at most."""
    for slices in range(radius + 1, BITS // BLOCK + 1):
        blocks = (slices - radius) * (BITS // BLOCK) // slices
        if count * 0.375 ** blocks <= KEY_LOAD:  # two random blocks have as many bits set
            break
    return slices


def keys_of(prints: np.ndarray, slices: int, radius: int = RADIUS) -> np.ndarray:
    """One row per fingerprint, one column per choice of slices: the coordinates as a number."""
    table = distances(prints, BLOCK_REFERENCES).astype(np.int16)
    coordinates = (table[:, :1] - table[:, 1:] + BLOCK) // 2  # bits set in each block
    dealt = [np.arange(s, BITS // BLOCK, slices) for s in range(slices)]
    keys = []
    for number, chosen in enumerate(combinations(range(slices), slices - radius)):
        key = np.full(len(prints), number, np.uint64)
        for block in np.concatenate([dealt[s] for s in chosen]):
            key = key * np.uint64(BLOCK + 1) + coordinates[:, block].astype(np.uint64)
        keys.append(key)
    return np.stack(keys, axis=1)


def near(table: np.ndarray, rows: np.ndarray, columns: np.ndarray, radius: int) -> np.ndarray:
    """Matrix of the pairs that the first references do not discard."""
    kept = np.ones((len(rows), len(columns)), bool)
    for reference in range(FIRST_REFERENCES):  # unsigned bytes wrap around: one comparison does
        kept &= table[rows, reference][:, None] - table[columns, reference] + np.uint8(radius) <= 2 * radius
    return kept


def verified(prints: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray,
             radius: int) -> np.ndarray:
    """Which pairs no reference discards and whose fingerprints are within the radius."""
    apart = table[left] - table[right] + np.uint8(radius)
    kept = np.flatnonzero((apart <= 2 * radius).all(axis=1))
    return kept[np.bitwise_count(prints[left[kept]] ^ prints[right[kept]]) <= radius]


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member reached) of a spanning forest of the links in ``prints``."""
    table = distances(prints, SPREAD_REFERENCES)
    every = np.arange(len(prints))
    if len(prints) <= MATRIX:
        left, right = np.nonzero(np.tril(near(table, every, every, radius), -1))
        found = verified(prints, table, left, right, radius)
        left, right, label = left[found], right[found], every.copy()
        while True:
            least = label.copy()
            np.minimum.at(least, left, label[right])
            np.minimum.at(least, right, label[left])
            least = least[least]
            if (least == label).all():
                break
            label = least
        moved = np.flatnonzero(label != every)
        return prints[moved], prints[label[moved]]
    members, hubs, left = [], [], every
    while len(left):
        hub, left = left[0], left[1:]
        queue = [hub]
        while queue and len(left):
            at = np.array(queue[-1:])
            queue.pop()
            close = np.flatnonzero(near(table, at, left, radius)[0])
            close = close[verified(prints, table, np.repeat(at, len(close)), left[close], radius)]
            if len(close):
                members.append(left[close])
                hubs.append(np.full(len(close), hub))
                queue.extend(left[close].tolist())
                left = np.delete(left, close)
    if not members:
        return prints[:0], prints[:0]
    return prints[np.concatenate(members)], prints[np.concatenate(hubs)]


def links(prints: DataFrame, count: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: each component of links is spanned by them."""
    slices = slices_for(count, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            keys = keys_of(values.view(np.uint64), slices, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(values, keys.shape[1]))],
                ["key", "fingerprint"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = [forest(values[a:b], radius) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[side] for f in found] or [values[:0]]).view(np.int64))
                 for side in (0, 1)], ["a", "b"])

    keyed = prints.select("fingerprint").mapInArrow(spread, "key long, fingerprint long")
    large = keyed.groupBy("key").count().filter(F.col("count") > chunk).select(
        "key", F.ceil(F.col("count") / chunk * 2).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    # a chunk meets every other chunk of its key; a pair of chunks also holds the links inside both
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own"))
    parted = keyed.join(large, "key", "left").withColumn("own", own).withColumn(
        "pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit("")))
                          .otherwise(F.transform(others, lambda c: F.concat_ws(
                              "-", F.least(c, F.col("own")), F.greatest(c, F.col("own")))))))
    gathered = parted.groupBy("key", "pair").agg(F.collect_list("fingerprint").alias("members"))
    return gathered.filter(F.size("members") > 1).select("members").mapInArrow(
        search, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of ``words``-word shingles are linked where ``radius`` bits or fewer differ;
    component_id is the smallest doc_id that links reach, the document's own included.  A
    null text counts as empty; texts without words have fingerprint zero and are linked
    like any other.  Equal fingerprints count once in the search, so copies cost no pairs.
    Repeated rows stay repeated; columns other than doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(with_fingerprints(docs, words), "prints")
    nodes = scratch.write(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "nodes")
    edges = links(nodes, nodes.count(), radius)
    roots = connected_components(edges).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id; all columns.

    Documents without a doc_id stay.
    """
    dropped = simhash_dedup(docs, words, radius).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
