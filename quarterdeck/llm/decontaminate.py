"""Benchmark decontamination by SimHash of item-sized windows.

For every item length, a document's windows of that many words (the whole document, where it
is shorter) get a SimHash of their five-word shingles.  The items' fingerprints are indexed by blocks of bits: two fingerprints
within ``RADIUS`` bits differ by at most RADIUS // BLOCKS bits in one of the blocks, so the
buckets whose block value is that near hold every item within the radius.  Candidates are
verified on the shingles themselves: the weight (number of occurrences) that the window
shares with the item, over the item's weight.

Only windows with enough shingles that occur in some item can reach the similarity, so only
those are fingerprinted; that is a bound, not an estimate.  The benchmark is the stated query
set: its size is bounded and checked, and it travels to every task, so documents are never
shuffled, however many share a passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import whole_text

WORDS = 5
SIMILARITY = 0.8
#: at a similarity of just 0.8, fingerprints differ by 13 bits of 64 on average, and by more
#: than this in about one window of 2,000
RADIUS = 24
BLOCKS = 5
MOST_BENCHMARK_BYTES = 256 << 20
WORD = re.compile(r"\w+")
#: pieces between white space that a task remembers
REMEMBERED = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * STEP
    return values ^ (values >> np.uint64(32))


def shingles_at(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` word ids from each of ``starts``."""
    hashes = np.zeros(len(starts), np.uint64)
    for at in range(width):
        hashes = mixed(hashes * STEP + ids[starts + at].astype(np.uint64))
    return hashes


class Pieces(dict):
    """Ids of the words between white space; -1 for pieces of none or several words, see ``uneven``."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.uneven = vocabulary, {}

    def clear(self):
        super().clear()
        self.uneven.clear()

    def __missing__(self, piece: str) -> int:
        words = WORD.findall(piece)
        ids = [self.vocabulary.get(w, 0) for w in words]
        if len(ids) != 1:
            self.uneven[piece] = ids
        self[piece] = ids[0] if len(ids) == 1 else -1
        return self[piece]


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` consecutive shingle hashes from each of ``starts``."""
    first, last = starts.min(), starts.max() + size
    bits = np.unpackbits(hashes[first:last].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    most = 2 * (sums[starts - first + size] - sums[starts - first]) > size
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


class BlockIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.near = prints, radius, radius // blocks
        bounds = [64 * b // blocks for b in range(blocks + 1)]
        self.cuts = [(np.uint64(a), np.uint64((1 << b - a) - 1)) for a, b in zip(bounds, bounds[1:])]
        self.buckets = []
        for shift, mask in self.cuts:
            values, bucket = np.unique(prints >> shift & mask, return_inverse=True)
            order = np.argsort(bucket, kind="stable")
            self.buckets.append((values, np.split(order, np.cumsum(np.bincount(bucket))[:-1])))

    def within(self, wanted: int) -> np.ndarray:
        """Positions of all fingerprints within the radius of ``wanted``."""
        found = [members[i] for (shift, mask), (values, members) in zip(self.cuts, self.buckets)
                 for i in np.flatnonzero(np.bitwise_count(values ^ (wanted >> shift & mask)) <= self.near)]
        if not found:
            return np.zeros(0, np.int64)
        candidates = np.unique(np.concatenate(found))
        return candidates[np.bitwise_count(self.prints[candidates] ^ wanted) <= self.radius]


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: dict[int, str], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.vocabulary: dict[str, int] = {}
        by_size: dict[tuple[int, int], list] = defaultdict(list)
        for item_id, text in sorted(items.items()):
            words = WORD.findall(text.lower())
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                width = min(WORDS, len(ids))
                by_size[width, len(ids) - width + 1].append((item_id, ids))
        self.sizes, hashes = {}, defaultdict(dict)
        for (width, size), members in by_size.items():
            each = [shingles_at(np.array(ids), np.arange(size), width) for _, ids in members]
            for value in {v for h in each for v in h.tolist()}:
                hashes[width].setdefault(value, []).append(size)
            prints = np.concatenate([window_prints(h, np.zeros(1, np.int64), size) for h in each])
            shingles = [Counter(zip(*(ids[k:] for k in range(width)))) for _, ids in members]
            self.sizes[width, size] = (BlockIndex(prints), [i for i, _ in members], shingles)
        self.pieces = Pieces(self.vocabulary)
        # shingles of items in order, and the sizes of the items that have them
        self.known = {width: np.array(sorted(h), np.uint64) for width, h in hashes.items()}
        self.sizes_of = {width: [h[v] for v in sorted(h)] for width, h in hashes.items()}

    def word_ids(self, text: str) -> np.ndarray:
        """Ids of the text's words; zero for words of no item."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        # one look-up per piece between white space; most pieces hold one word
        pieces = text.lower().split()
        ids = np.array(list(map(self.pieces.__getitem__, pieces)), np.int64)
        if (ids >= 0).all():
            return ids
        uneven = self.pieces.uneven
        return np.array([i for p, one in zip(pieces, ids.tolist()) for i in (uneven[p] if one < 0 else (one,))],
                        np.int64)

    def find(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of each item's best window."""
        ids = self.word_ids(text)
        best: dict[int, tuple[float, int, int]] = {}
        for width, known in self.known.items():
            if len(ids) < width:
                continue
            # a shingle of an item has no word that is in no item
            whole = ids[:len(ids) - width + 1] > 0
            for at in range(1, width):
                whole &= ids[at:at + len(whole)] > 0
            places = np.flatnonzero(whole)
            own = shingles_at(ids, places, width)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = known[at] == own
            by_size: dict[int, list[int]] = defaultdict(list)
            for place, which in zip(places[found].tolist(), at[found].tolist()):
                for size in self.sizes_of[width][which]:
                    by_size[size].append(place)
            hashes = None
            for size, hit_places in by_size.items():
                enough = math.ceil(self.similarity * size - 1e-9)
                if len(hit_places) < enough:
                    continue
                if hashes is None:
                    hashes = shingles_at(ids, np.arange(len(whole)), width)
                hits = np.zeros(len(whole), np.int32)
                hits[hit_places] = 1
                sums = np.concatenate(([0], np.cumsum(hits)))
                index, item_ids, shingles = self.sizes[width, size]
                held_size = min(size, len(whole))  # of an item longer than the document: all of the document
                starts = np.flatnonzero(sums[held_size:] - sums[:-held_size] >= enough)
                if not len(starts):
                    continue
                for start, wanted in zip(starts.tolist(), window_prints(hashes, starts, held_size)):
                    near = index.within(wanted)
                    if len(near):
                        window = ids[start:start + held_size + width - 1].tolist()
                        held = Counter(zip(*(window[k:] for k in range(width))))
                        for at in near:
                            shared = sum(min(n, shingles[at][s]) for s, n in held.items() if s in shingles[at])
                            if shared >= enough and shared / size > best.get(item_ids[at], (0.0,))[0]:
                                best[item_ids[at]] = (shared / size, start, held_size + width - 1)
        return [(item, *rest) for item, rest in sorted(best.items())]


def read_items(benchmark: DataFrame) -> dict[int, str]:
    """The benchmark's texts by id; refuses a benchmark above the stated size."""
    size = benchmark.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {size} bytes; give it in parts of {MOST_BENCHMARK_BYTES}")
    kept: dict[int, str] = {}
    for row in benchmark.select("item_id", whole_text().alias("text")).filter("item_id IS NOT NULL").collect():
        kept[row["item_id"]] = max(row["text"], kept.get(row["item_id"], ""))
    return kept


def matches(benchmark: DataFrame, text: Column, similarity: float = SIMILARITY) -> Column:
    """Column of the items found in ``text``: item_id, similarity, first_word and words of the
    best window of each (the first one among equals)."""
    items = read_items(benchmark)

    def search(batches):
        matcher = Matcher(items, similarity)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "similarity": s, "first_word": a, "words": n}
                              for i, s, a, n in matcher.find(t)] for t in texts])

    from collections.abc import Iterator
    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    kind = "array<struct<item_id: long, similarity: double, first_word: long, words: long>>"
    return F.pandas_udf(search, kind)(text)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, words.

    Words are runs of letters, digits and underscores, lower-cased; items shorter than five
    words are one shingle and must occur whole; items without words are never found.  A document
    shorter than an item is one window, weighed against the whole item.  Of
    items that share an id the greatest text counts; items without an id are left out.  Null
    texts count as empty.  Rows repeated in ``docs`` give repeated rows.
    """
    found = docs.select("doc_id", matches(benchmark, whole_text(), similarity).alias("_found"))
    return found.select("doc_id", F.explode("_found").alias("_leak")).select("doc_id", "_leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    return docs.filter(F.size(matches(benchmark, whole_text(), similarity)) == 0)
