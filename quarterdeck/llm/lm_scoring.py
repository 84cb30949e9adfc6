"""Log-probabilities of texts by a weighted backoff automaton of smoothed n-grams.

Tokens are a text's words, lower-cased in A-Z, and one end.  An n-gram of the training texts is
an arc: from the state of the words before it, to the state of the longest end of it that is
itself followed by something.  A state's failure arc leads to the state of one word less, with
the weight that smoothing leaves to it:

    P(w | h) = (c(h w) + K * P(w | h without its first word)) / (c(h) + K)

and, below, P(w) = (c(w) + 1) / (N + V + 1), where all unknown words are one more kind.  A text
is read once from left to right: the automaton takes the state's arc of the token, or failure
arcs until there is one, and adds up the logarithms.

Counts cover all n-grams of all training texts.  No task sees the whole automaton: texts come
in blocks, each block asks for the counts of its own n-grams (``token_blocks``) and builds the
part of the automaton that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import token_blocks as tb
from quarterdeck.llm.scratch import Scratch, crc32_of, whole_text

ORDER = 3
#: K by length of the n-gram: how many observations the shorter one's estimate counts for
STRENGTH = {2: 1000.0, 3: 3.0}
END = 0

BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                   ("held", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_trained", pa.int64()),
                   ("tokens", pa.binary()), ("n_words", pa.int64()), ("word_bytes", pa.int64()), ("words", pa.binary())])
REQUEST = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                     ("counts", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()),
                    ("distinct", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])


def to_blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """Whole texts as blocks of numbers; every text ends with number ``END``."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, held, parts, size = tb.Numbers(1), [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            lengths = [len(p) for p in parts]
            listed = list(words)
            return pa.RecordBatch.from_pylist([{
                "block": tb.new_block(), "doc_ids": ids, "lengths": lengths, "held": held, "n_tokens": len(tokens),
                "n_trained": sum(n for n, h in zip(lengths, held) if not h), "tokens": tb.packed(tokens),
                "n_words": len(listed), "word_bytes": sum(map(len, listed)) + max(0, len(listed) - 1),
                "words": tb.packed_words(listed)}], BLOCK)

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = words.of(text.encode("utf-8", "surrogatepass").lower().split())
                parts.append(np.append(found, np.int32(END)))
                ids.append(doc_id)
                held.append(int(out))
                size += len(found) + 1
                if size >= block_words:
                    yield flush()
                    words, ids, held, parts, size = tb.Numbers(1), [], [], [], 0
        if parts:
            yield flush()

    held_out = F.coalesce(crc32_of("doc_id") % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), whole_text().alias("text")).mapInArrow(
        number, tb.ddl(BLOCK))


class Grams:
    """The distinct n-grams of a block by length: keys, counts in training texts, parents.

    ``context`` and ``shorter`` number an n-gram's first and last n - 1 words among the n-grams of
    that length; ``at`` has the n-gram that ends at each token, or -1.  The start of a text is
    a word of its own as a context, numbered after the others.
    """

    def __init__(self, block: dict, order: int):
        self.tokens = tb.unpacked(block["tokens"], block["n_tokens"], np.int32).astype(np.int64)
        lengths = np.array(block["lengths"])
        words = tb.unpacked_words(block["words"], block["word_bytes"])
        self.size = block["n_words"] + 1  # with the end
        hashes = np.concatenate((tb.word_keys([b"\n"]), tb.word_keys(words)))
        trained = np.repeat(1 - np.array(block["held"]), lengths)
        self.ends = np.cumsum(lengths) - 1
        first = np.zeros(len(self.tokens), bool)
        first[self.ends[:-1] + 1] = first[0] = True
        self.keys = [np.append(hashes, tb.word_keys([b"\n\n"]))]
        # the start stands as often as the end
        counts = np.bincount(self.tokens, trained, self.size)
        self.counts = [np.append(counts, counts[END]).astype(np.int64)]
        self.context: list[np.ndarray] = [np.zeros(self.size + 1, np.int64)]
        self.shorter: list[np.ndarray] = [np.zeros(self.size + 1, np.int64)]
        self.at = [self.tokens]
        before = np.append(self.size, self.tokens[:-1])
        before[first] = self.size
        for n in range(2, order + 1):
            there = np.flatnonzero(before >= 0)
            code, place = np.unique(before[there] * (self.size + 1) + self.tokens[there], return_inverse=True)
            self.keys.append(tb.longer_keys(self.keys[-1][code // (self.size + 1)], hashes[code % (self.size + 1)]))
            self.counts.append(np.bincount(place, trained[there], len(code)).astype(np.int64))
            self.context.append(code // (self.size + 1))
            shorter = np.zeros(len(code), np.int64)
            shorter[place] = self.at[-1][there]
            self.shorter.append(shorter)
            now = np.full(len(self.tokens), -1, np.int64)
            now[there] = place
            self.at.append(now)
            before = np.append(-1, now[:-1])
            before[first] = -1


def ask(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each block's n-grams and their counts in it, by bucket of length and key."""
    def requests(block: dict) -> Iterator[dict]:
        grams = Grams(block, order)
        for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts)):
            by_key = np.argsort(keys)
            for bucket, size, sent, number in tb.deal(keys[by_key], counts[by_key], buckets):
                yield {"bucket": n * buckets + bucket, "block": block["block"], "n": size, "keys": sent, "counts": number}

    return tb.map_blocks(blocks, requests, REQUEST)


def answer(requests: DataFrame) -> DataFrame:
    """For each block and bucket the counts in all blocks, in the order of the keys sent; in one row
    of each bucket also how many of its keys occur in training texts."""
    def reply(sent: pa.Table) -> pa.Table:
        rows = sent.to_pydict()
        _, sums, place = tb.added_up(rows["n"], rows["keys"], rows["counts"])
        edges = np.cumsum(rows["n"])[:-1]
        return pa.table({
            "bucket": rows["bucket"], "block": rows["block"], "n": rows["n"],
            "counts": pa.array([tb.packed(c) for c in np.split(sums[place], edges)], pa.binary()),
            "distinct": [int((sums > 0).sum())] + [0] * (len(edges))}, ANSWER)

    return requests.groupBy("bucket").applyInArrow(reply, tb.ddl(ANSWER))


class Automaton:
    """The states and arcs that a block's texts can reach, by token of the block.

    A state is known by how many words it holds, as the n-gram that ends there numbers it.  For
    the arc of n words that ends at a token: ``known`` tells whether training texts have it,
    ``gain`` is its weight, and ``leave`` the weight of the failure arc of the state before it.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, kinds: int, strength: dict[int, float]):
        share = (counts[0] + 1.0) / (total + kinds + 1)
        self.base = np.log10(share)[grams.tokens]
        self.seen = (counts[0] > 0)[grams.tokens]
        self.gain, self.known, self.leave = [self.base], [self.seen], [np.zeros(len(self.base))]
        for n in range(2, len(counts) + 1):
            before, pull = counts[n - 2][grams.context[n - 1]], strength[n]
            share = (counts[n - 1] + pull * share[grams.shorter[n - 1]]) / (before + pull)
            there = np.flatnonzero(grams.at[n - 1] >= 0)
            for values, lists in ((np.log10(share), self.gain), (counts[n - 1] > 0, self.known),
                                  (np.log10(pull / (before + pull)), self.leave)):
                by_token = np.zeros(len(grams.tokens), values.dtype)
                by_token[there] = values[grams.at[n - 1][there]]
                lists.append(by_token)

    def read(self, begin: int, end: int) -> float:
        """The log10 probability of a text, in one traversal from its start state."""
        gain, known, leave = ([v[begin:end].tolist() for v in values] for values in (self.gain, self.known, self.leave))
        most = len(gain) - 1
        state, score = min(1, most), 0.0
        for i in range(end - begin):
            while state and not known[state][i]:
                score += leave[state][i]
                state -= 1
            score += gain[state][i]
            if state or known[0][i]:
                # one word more, or as many as a state holds
                state = state + 1 if state < most else most
        return score


def score_block(block: dict, answers: list[dict], order: int, total: int, kinds: int,
                strength: dict[int, float], buckets: int) -> Iterator[dict]:
    grams, counts = Grams(block, order), []
    answers = sorted(answers, key=lambda a: a["bucket"])
    for n, keys in enumerate(grams.keys):
        sums = [tb.unpacked(a["counts"], a["n"], np.uint64) for a in answers if a["bucket"] // buckets == n]
        count = np.zeros(len(keys), np.int64)
        if sums:
            count[np.argsort(keys)] = np.concatenate(sums).astype(np.int64)
        counts.append(count)
    automaton = Automaton(grams, counts, total, kinds, strength)
    begin = 0
    for doc_id, held, end in zip(block["doc_ids"], block["held"], (grams.ends + 1).tolist()):
        yield {"doc_id": doc_id, "held_out": bool(held), "n_tokens": end - begin,
               "n_known": int(automaton.seen[begin:end].sum()),
               "base_score": float(automaton.base[begin:end].sum()), "score": automaton.read(begin, end)}
        begin = end


def score_texts(docs: DataFrame, order: int = ORDER, strength: dict[int, float] | None = None,
                block_words: int = tb.BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) mod 7 is 2 are held out, all others train the model; a null
    doc_id trains.  Null and empty texts are one end.  Repeated rows count and are scored one by
    one; an empty table gives an empty result, a table without training texts gives every token
    the share of an unknown one.  Other columns of ``docs`` are not read.  A text is never cut,
    so the longest text and its block have to fit into a task.
    """
    strength = STRENGTH if strength is None else strength
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.write(to_blocks(docs, block_words), "blocks")
    words, total = blocks.agg(F.sum("n_tokens"), F.sum("n_trained")).first()
    buckets = tb.bucket_count(words or 0)
    answers = scratch.write(answer(ask(blocks, order, buckets)), "answers")
    total = total or 0
    # the start is no token
    kinds = (answers.filter(F.col("bucket") < buckets).agg(F.sum("distinct")).first()[0] or 0) - (total > 0)

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        found, listed = [], replies.to_pylist()
        for row in block.to_pylist():
            found += score_block(row, listed, order, total, kinds, strength, buckets)
        return pa.Table.from_pylist(found, SCORED)

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, tb.ddl(SCORED))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score")
