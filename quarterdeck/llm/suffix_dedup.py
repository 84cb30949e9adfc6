"""Removal of passages that occur twice, by suffix order.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else in
the corpus.  Such strings are found by ordering suffixes (``suffix_order``): equal strings
start at neighbouring suffixes.  A corpus has far too many suffixes for one order, and nearly
all of them are alone, so the strings are first dealt into groups that can be ordered apart:

* every string of LENGTH bytes has an anchor, the GRAM bytes in it whose hash is least; equal
  strings have equal anchors at equal places, so strings are compared only where anchors are
  equal.  Neighbouring strings share their anchor; they and the bytes they cover are one
  *stretch*.  Anchors that occur once are dropped, with all their strings.
* equal stretches are gathered before anything else: they remove all their bytes and go on
  as one, which the others are still compared with.
* stretches with one anchor form a group.  A group with more than ``GROUP`` different
  stretches is split: the anchor is drawn out to the left for the strings that reach farther
  left, and to the right for the others.  Strings that are equal agree in the longer anchor
  too.  After at most a few rounds the anchor is the whole string.

What is left, the stretches of small groups, is cut to what can equal another around the
anchor, and ordered, many groups at a time.  Nothing is
ever gathered by document or by anchor beyond GROUP stretches and a document's own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch, whole_text
from quarterdeck.llm.suffix_order import suffix_order

LENGTH = 200
GRAM = 50
#: different stretches that one group may hold
GROUP = 256
#: bytes that are looked at in one go
SEGMENT = 1 << 21
#: bytes that are ordered in one go
ORDERED = 1 << 18
ODD = 0x9E3779B97F4A7C15
#: inverse of ODD modulo 2^64
INVERSE = pow(ODD, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def powers(base: int, count: int) -> np.ndarray:
    """base^0 ... base^(count - 1) modulo 2^64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Hashes:
    """Hashes of substrings of ``data`` (bytes), from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ODD, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, starts, ends) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def every(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:count]) * self.back[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1:width - 1 + count])


def stretches(data: np.ndarray, owner_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, strings, anchor offset, anchor hash, hash of the stretch) of texts laid end to end.

    ``owner_ends`` are the ends of the texts; no stretch crosses one.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    hashes = Hashes(data)
    grams = hashes.every(GRAM)
    low = np.uint64((1 << 22) - 1)  # positions fit: a segment is shorter
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)  # +1 where a string crosses the end of a text
    ends = owner_ends[:-1]
    np.add.at(inside, np.maximum(ends - LENGTH + 1, 0), 1)
    np.add.at(inside, ends, -1)
    valid = np.cumsum(inside)[:len(anchor)] == 0
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none, none
    at = anchor[starts]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    begins = np.flatnonzero(new)
    first, strings = starts[begins], np.diff(np.append(begins, len(starts)))
    offset = at[begins] - first
    whole = hashes.of(first, first + strings + LENGTH - 1)
    whole = mixed(whole ^ mixed((offset * 1024 + strings).astype(np.uint64)))
    return first, strings, offset, grams[at[begins]].view(np.int64), whole.view(np.int64)


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as lists of (number, start, bytes) of about SEGMENT bytes; long texts in overlapping parts."""
    batch, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[start:start + SEGMENT + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > 2 * SEGMENT - 1:
                yield batch
                batch, size = [], 0
            batch.append((number, start, part))
            size += len(part)
    if batch:
        yield batch


def find_stretches(rows: DataFrame) -> DataFrame:
    """row_id, key (anchor), same (hash of the stretch), start, strings, anchor of every stretch."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for parts in segments([t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]):
                ends = np.cumsum([len(p) for _, _, p in parts])
                first, strings, offset, key, same = stretches(
                    np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), ends)
                part = np.searchsorted(ends, first, side="right")
                base = np.array([s for _, s, _ in parts], np.int64) - (ends - [len(p) for _, _, p in parts])
                owner = row_ids[[n for n, _, _ in parts]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[part]), pa.array(key), pa.array(same), pa.array(first + base[part]),
                     pa.array(strings.astype(np.int32)), pa.array(offset.astype(np.int32))],
                    ["row_id", "key", "same", "start", "strings", "anchor"])

    return rows.mapInArrow(
        find, "row_id long, key long, same long, start long, strings int, anchor int")


def settle(items: DataFrame) -> DataFrame:
    """Add to stretches whose key occurs again: ``copies`` (equal ones under the key), ``hot``
    (the key has more than GROUP different ones) and ``compare`` (to be compared with others:
    one of equal ones, where the key has different ones and not all of them occur twice)."""
    place = F.xxhash64("row_id", "start")
    each = items.groupBy("key", "same").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
    keys = each.groupBy("key").agg(
        F.sum("copies").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")).filter("total > 1")
    return items.join(each, ["key", "same"]).join(keys, "key").withColumns({
        "hot": F.col("kinds") > GROUP,
        "compare": (F.col("kinds") > 1) & (F.col("fewest") == 1) & ((F.col("copies") == 1) | (place == F.col("first")))}
    ).drop("total", "kinds", "fewest", "first", "same")


def twice(known: DataFrame) -> DataFrame:
    """Stretches that occur twice as a whole."""
    return known.filter("copies > 1").select("row_id", "start", "strings")


def to_compare(known: DataFrame) -> DataFrame:
    return known.filter("compare").withColumn("settled", F.col("copies") > 1).drop("copies", "compare")


def with_bytes(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Add the bytes of each stretch; a text is read once, whatever number of stretches it has."""
    listed = items.groupBy("row_id").agg(F.collect_list(F.struct(
        "key", "start", "strings", "anchor", "settled", "hot")).alias("items"))

    names = ("key", "start", "strings", "anchor", "settled", "hot")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            columns = {name: flat.field(name) for name in names}
            counts = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            spans = zip(owner.tolist(), columns["start"].to_pylist(), columns["strings"].to_pylist())
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            pieces = pa.array([texts[o][s:s + n + LENGTH - 1] for o, s, n in spans], pa.binary())
            width = pa.array(np.full(len(owner), GRAM, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), *(columns[n] for n in names[:4]), width,
                 *(columns[n] for n in names[4:]), pieces], ["row_id", *names[:4], "width", *names[4:], "bytes"])

    return rows.join(listed, "row_id").select("row_id", "text", "items").mapInArrow(
        cut, "row_id long, key long, start long, strings int, anchor int, width int, settled boolean, hot boolean, "
             "bytes binary")


def draw_out(hot: DataFrame) -> DataFrame:
    """Stretches of crowded keys under longer anchors: each gives one part for the strings that
    reach farther left than half the slack, and one for the others."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for item in batch.to_pylist():
                a, b = item["anchor"], item["anchor"] + item["width"]
                left = (LENGTH - item["width"] + 1) // 2
                right = LENGTH - item["width"] - left + 1
                # strings from a - left back hold the anchor drawn out to the left; the others to the right
                far = max(0, min(item["strings"], a - left + 1))
                for side, lo, hi, start, end in ((0, 0, far, a - left, b), (1, far, item["strings"], a, b + right)):
                    if lo >= hi:
                        continue
                    piece = item["bytes"][lo:hi + LENGTH - 1]
                    key = hashlib.blake2b(item["bytes"][start:end] + item["key"].to_bytes(8, "little", signed=True)
                                          + bytes([side]), digest_size=8).digest()
                    same = hashlib.blake2b(piece + (start - lo).to_bytes(4, "little"), digest_size=8).digest()
                    for column, value in zip(out, (
                            item["row_id"], int.from_bytes(key, "little", signed=True),
                            int.from_bytes(same, "little", signed=True), item["start"] + lo, hi - lo, start - lo,
                            end - start, piece)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [
                "row_id", "key", "same", "start", "strings", "anchor", "width", "bytes"])

    return hot.select("row_id", "key", "start", "strings", "anchor", "width", "bytes").mapInArrow(
        split, "row_id long, key long, same long, start long, strings int, anchor int, width int, bytes binary")


def repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of different pieces, which of its strings of LENGTH bytes occur twice in them all."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int(lengths.sum()) + len(pieces), np.int64)
    data = np.zeros(len(symbols), np.uint8)
    for number, (begin, piece) in enumerate(zip(begins.tolist(), pieces)):
        data[begin:begin + len(piece)] = np.frombuffer(piece, np.uint8)
        symbols[begin + len(piece)] = number  # each end differs from all others, and comes before any byte
    inner = np.ones(len(symbols), bool)
    inner[begins + lengths] = False
    symbols[inner] = data[inner].astype(np.int64) + len(pieces)
    order = suffix_order(symbols)
    left = np.repeat(begins + lengths, lengths + 1) - np.arange(len(symbols))  # bytes before the piece ends
    order = order[left[order] >= LENGTH]
    hashes = Hashes(data).every(LENGTH)
    equal = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    raw = data.tobytes()
    equal = [k for k in equal.tolist() if raw[(a := order[k]):a + LENGTH] == raw[(b := order[k + 1]):b + LENGTH]]
    twice = np.zeros(len(symbols), bool)
    twice[order[equal]] = True
    twice[order[[k + 1 for k in equal]]] = True
    return [twice[b:b + max(0, n - LENGTH + 1)] for b, n in zip(begins.tolist(), lengths.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def reach(texts: list[bytes]) -> list[int]:
    """For each text, the longest prefix that it has in common with any other."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        shared = common(texts[i], texts[j])
        out[i], out[j] = max(out[i], shared), max(out[j], shared)
    return out


def crops(members: list[dict]) -> list[tuple[int, bytes]]:
    """For each stretch of a group: first byte and bytes of the part that some other can equal.

    Around the common anchor, a stretch can equal others no farther to either side than the
    nearest of them does.  Parts shorter than LENGTH are empty: nothing in them occurs twice.
    """
    distinct = {(m["bytes"], m["anchor"]): k for k, m in enumerate(members)}
    if len(distinct) == 1:
        return [(0, m["bytes"]) for m in members]
    width = members[0]["width"]
    before = reach([text[:a][::-1] for text, a in distinct])
    after = reach([text[a + width:] for text, a in distinct])
    parts = {}
    for (text, a), left, right in zip(distinct, before, after):
        parts[text, a] = (a - left, text[a - left:a + width + right] if left + width + right >= LENGTH else b"")
    return [parts[m["bytes"], m["anchor"]] for m in members]


def ordered(items: DataFrame) -> DataFrame:
    """row_id, start, strings of what occurs twice within the small groups."""
    groups = items.groupBy("key").agg(F.collect_list(F.struct(
        "row_id", "start", "anchor", "width", "settled", "bytes")).alias("members"))

    def compare(held: list[tuple[dict, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        """Many whole groups at once; equal bytes of different groups are equal strings all the same."""
        seen: dict[bytes, int] = {}
        for _, _, part in held:
            seen[part] = seen.get(part, 0) + 1
        found = dict(zip(seen, map(runs, repeated_starts(list(seen)))))
        for m, at, part in held:
            if not m["settled"]:
                whole = [(0, len(part) - LENGTH + 1)]
                for first, count in whole if seen[part] > 1 else found[part]:
                    yield m["row_id"], m["start"] + at + first, count

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held):
            rows = list(compare(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int32())], ["row_id", "start", "strings"])

        held, size = [], 0
        for batch in batches:
            for members in batch.column(0).to_pylist():
                for m, (at, part) in zip(members, crops(members)):
                    if part:
                        held.append((m, at, part))
                        size += len(part)
                if size > ORDERED:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return groups.select("members").mapInArrow(order, "row_id long, start long, strings int")


def removed_starts(rows: DataFrame) -> DataFrame:
    """row_id, start, strings: runs of starts of strings that also start elsewhere.

    ``rows``: row_id and text.
    """
    scratch = Scratch(rows.sparkSession, "suffixes")
    found = find_stretches(rows)
    again = found.groupBy("key").count().filter("count > 1").select("key")
    candidates = scratch.write(found.join(again, "key", "left_semi"), "candidates")
    known = scratch.write(settle(candidates), "known")
    scratch.drop("candidates")
    parts = [twice(known)]
    items, level = scratch.write(with_bytes(rows, to_compare(known)), "items0"), 0
    while True:
        parts.append(scratch.write(ordered(items.filter("NOT hot")), f"ordered{level}"))
        hot = items.filter("hot")
        if hot.isEmpty():
            break
        level += 1
        known = scratch.write(settle(scratch.write(draw_out(hot), f"drawn{level}")), f"known{level}")
        scratch.drop(f"drawn{level}")
        scratch.drop(f"items{level - 1}")
        parts.append(twice(known))
        items = to_compare(known)
        items = scratch.write(items, f"items{level}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cut_out(data: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data``, and the removed spans (first, end), from runs of starts."""
    spans: list[list[int]] = []
    for first, count in sorted(starts):
        end = first + count + LENGTH - 1
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at:first])
        at = end
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in spans]


def different_texts(texts: DataFrame, equal: DataFrame) -> DataFrame:
    """``texts`` with one row of each row_id; ``equal`` are the row_ids that occur more than once."""
    once = texts.join(equal, "row_id", "left_anti")
    return once.unionByName(texts.join(equal, "row_id", "left_semi").groupBy("row_id").agg(F.first("text").alias("text")))


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_kept`` also spans (array of first and end byte) and kept (binary, what is left).

    Texts are taken as UTF-8 bytes, null as empty; strings are judged on the texts as given.
    Every occurrence goes, the first one too.  Rows repeated with one doc_id are documents of
    their own, and so remove each other if long enough; of rows equal in doc_id and text,
    whatever their number, one is compared with the others.  Other columns are ignored.
    """
    # rows equal in doc_id and text share a row_id; they also share what is removed from them
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("row_id", F.xxhash64("doc_id", "text"))
    equal = Scratch(docs.sparkSession, "equal-rows").write(
        rows.groupBy("row_id").count().filter("count > 1").select("row_id"), "equal")
    texts = different_texts(rows.select("row_id", "text"), equal)
    starts = removed_starts(texts).groupBy("row_id").agg(F.collect_list(F.struct("start", "strings")).alias("starts"))
    # a row that has an equal one loses every byte that a string of LENGTH covers
    whole = equal.select("row_id", F.lit(True).alias("whole"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text, found, whole in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                data = text.encode("utf-8", "replace")
                if whole and len(data) >= LENGTH:
                    kept, spans = cut_out(data, [(0, len(data) - LENGTH + 1)])
                else:
                    kept, spans = cut_out(data, [(s["start"], s["strings"]) for s in found or ()])
                for column, value in zip(columns, (
                        len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept)):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            if with_kept:
                pair = pa.struct([("first", pa.int64()), ("end", pa.int64())])
                arrays += [pa.array([[{"first": a, "end": b} for a, b in s] for s in columns[4]], pa.list_(pair)),
                           pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", spans array<struct<first: long, end: long>>, kept binary" if with_kept else "")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_kept else [])]
    return rows.join(starts, "row_id", "left").join(whole, "row_id", "left").select(
        F.col("doc_id").cast("long"), "text", "starts", "whole").mapInArrow(cut, schema)
