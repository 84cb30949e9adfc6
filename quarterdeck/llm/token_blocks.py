"""Texts as blocks of word numbers, and counts of n-grams exchanged between blocks.

A block holds some documents' words as numbers into its own list of words.  What a block asks
of the corpus (how often do my n-grams occur?) goes out as sorted 64-bit keys, dealt over
buckets of the key space; a bucket adds up what all blocks sent.  A key occurs once per block,
however frequent it is, so no bucket grows with a hot word's occurrences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of a block, unless a single text is longer
BLOCK_WORDS = 1 << 20
#: counts travel as these
COUNT = np.uint64
#: keys that a bucket should receive, about
BUCKET_KEYS = 1 << 22


class Numbers(dict):
    """Words to numbers from ``first`` on, in the order in which they are met."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.first + len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes, most of which are zero planes that compress away."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, count * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).reshape(-1).view(kind)


def packed_words(words: list[bytes]) -> bytes:
    """Words hold no line feed."""
    return pa.compress(b"\n".join(words), codec="zstd", asbytes=True)


def unpacked_words(data: bytes, size: int) -> list[bytes]:
    joined = pa.decompress(data, size, codec="zstd", asbytes=True)
    return joined.split(b"\n") if joined else []


def new_block() -> int:
    """A number that no other block has; a task's output is committed once, so it need not be repeatable."""
    return uuid.uuid4().int >> 65


def word_keys(words: list[bytes], within: bytes = b"") -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(within + w, 7) for w in words), np.uint64, len(words))


def longer_keys(shorter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of all but their last words and of the last words."""
    with np.errstate(over="ignore"):
        z = shorter * np.uint64(0x9E3779B97F4A7C15) + word
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bucket_count(words: int) -> int:
    return max(1, -(-words // BUCKET_KEYS))


def deal(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Bucket, number of keys, packed keys and packed counts; ``keys`` are distinct and in order."""
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([b * width for b in range(buckets)], np.uint64)).tolist() + [len(keys)]
    for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            gaps = keys[a:b].copy()
            gaps[1:] -= keys[a:b - 1]
            yield bucket, b - a, packed(gaps), packed(counts[a:b].astype(COUNT))


def dealt_keys(data: bytes, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(data, count, np.uint64), dtype=np.uint64)


def added_up(sizes: list[int], keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, their sums, and for each key as it was sent the place of its sum."""
    sent = np.concatenate([dealt_keys(k, n) for k, n in zip(keys, sizes)])
    number = np.concatenate([unpacked(c, n, COUNT) for c, n in zip(counts, sizes)])
    distinct, place = np.unique(sent, return_inverse=True)
    return distinct, np.bincount(place, number, len(distinct)).astype(np.uint64), place


def ddl(shape: pa.Schema) -> str:
    """An Arrow schema of the types that blocks use as Spark's text form."""
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double",
             pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in shape)


def map_blocks(blocks: DataFrame, function: Callable[[dict], Iterator[dict]], shape: pa.Schema) -> DataFrame:
    """What ``function`` makes of the rows of ``blocks``, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(function(batch.slice(at, 1).to_pylist()[0]))
                if found:
                    yield pa.RecordBatch.from_pylist(found, shape)

    return blocks.mapInArrow(run, ddl(shape))


def total(blocks: DataFrame, column: str) -> int:
    return blocks.agg(F.sum(column)).first()[0] or 0
