"""Toxicity by two class-conditional Kneser-Ney models.

A word is spelt by a model of its characters: up to four characters before it predict the
next one.  The toxic and the ordinary model have their own counts of five-character
sequences, taken from labelled texts.  Where those are rare or absent, both fall back on the
same shared counts, which come from all texts, labelled or not: Kneser-Ney continuation
counts, that is, how many different characters stand before a shorter sequence.

A text's two log-likelihoods, normalised by its number of words, are compared: that of a toxic text,
each of whose words comes from the toxic model with the probability ``SHARE`` and from the
ordinary model else, and that of an ordinary one.  So every word counts, for either class.  As topic and
language shift every word a little and a toxic expression shifts one word by far, the mean of
what a word's difference has beyond ``MARGIN`` is a second input.  What both weigh is fitted on labelled
texts that the models have not seen.

The labelled sample and so the tables that travel to every task are bounded by
``SAMPLE_PER_CLASS``; the corpus counts cover every text and all its sequences, are combined as
distinct sequences, map-side first, and stay tables, from which what the sample needs is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch, crc32_of, whole_text

ORDER = 5
BITS = 12
DISCOUNT = 0.75
#: part of a toxic text's words that come from the toxic model
SHARE = 0.01
#: log-likelihood difference of a word beyond which the excess begins, and the mean excess that
#: a text has anyway
MARGIN = 2.0
FLOOR = 0.01
#: labelled texts of a class that are read, at most: three quarters for the models, the rest
#: to fit the scale of the score
SAMPLE_PER_CLASS = 4000
THRESHOLD = 0.7
#: characters beyond the sample's most frequent ones share one id
MOST_CHARACTERS = (1 << BITS) - 4
EDGE, END, OTHER = 1, 2, 3
NOT_SPELT = re.compile(r"\W+")
#: sequences that a task remembers to have sent
MOST_SEEN = 2_000_000
#: words whose score a task remembers
REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    """What white space separates; only letters, digits and underscores of it are spelt."""
    return text.lower().split()


def sequences(words: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-character sequences of all words packed into one long each, and each word's number of them."""
    words = [NOT_SPELT.sub("", w) for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stream = np.full(int(lengths.sum()) + (ORDER - 1) * len(words), EDGE, np.int64)
    ends = np.cumsum(lengths + ORDER - 1) - 1
    letters = np.ones(len(stream), bool)
    starts = ends - lengths - ORDER + 2
    for k in range(ORDER - 1):
        letters[starts + k] = False
    real = letters.copy()
    letters[ends] = False
    stream[ends] = END
    stream[letters] = np.fromiter((ids.get(c, OTHER) for w in words for c in w), np.int64, int(letters.sum()))
    packed = np.zeros(len(stream), np.int64)
    for back in range(ORDER):
        packed[back:] |= stream[:len(stream) - back] << (BITS * back)
    return packed[real], lengths


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float = 0.0) -> np.ndarray:
    """Values of ``wanted`` among sorted ``keys``, or ``absent``."""
    if not len(keys):
        return np.full(len(wanted), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], absent)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, values, len(distinct)).astype(float)


@dataclass
class Counts:
    """Counts of sequences of one length: by sequence, and by what stands before the last character.

    Where the sequences are a selection, the totals and kinds of their contexts are given.
    """

    keys: np.ndarray
    values: np.ndarray
    contexts: np.ndarray | None = None
    totals: np.ndarray | None = None
    kinds: np.ndarray | None = None

    def __post_init__(self):
        if self.contexts is None:
            self.contexts, self.totals = summed(self.keys >> BITS, self.values)
            _, self.kinds = summed(self.keys >> BITS, np.ones(len(self.keys)))

    def interpolate(self, wanted: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Discounted share of ``wanted`` after its context; the rest goes to ``lower``."""
        total = look_up(self.contexts, self.totals, wanted >> BITS)
        kinds = look_up(self.contexts, self.kinds, wanted >> BITS)
        own = np.maximum(look_up(self.keys, self.values, wanted) - DISCOUNT, 0)
        seen = total > 0
        total = np.where(seen, total, 1)
        return np.where(seen, (own + DISCOUNT * kinds * lower) / total, lower)

    def share_left(self, contexts: np.ndarray) -> np.ndarray:
        """What ``contexts`` leave to shorter sequences: all of it where they were not seen."""
        total = look_up(self.contexts, self.totals, contexts)
        return np.where(total > 0, DISCOUNT * look_up(self.contexts, self.kinds, contexts) / np.maximum(total, 1), 1.0)


def inputs_of(differences: np.ndarray) -> tuple[float, float]:
    """Of a text's words: mean log-likelihood of a toxic text less that of an ordinary one, and
    the logarithm of the mean excess."""
    return (np.log1p(SHARE * np.expm1(np.minimum(differences, 50))).mean(),
            np.log(FLOOR + np.maximum(differences - MARGIN, 0).mean()))


@dataclass
class Models:
    """Both classes' counts, the shared shorter ones, and the scale of the score."""

    ids: dict[str, int]
    shared: list[Counts]  # from one character to ORDER - 1
    toxic: Counts | None
    ordinary: Counts | None
    seen: tuple[np.ndarray, np.ndarray] | None = None
    left: tuple[np.ndarray, np.ndarray] | None = None
    slopes: tuple[float, float] = (1.0, 0.0)
    offset: float = 0.0

    def compile(self) -> None:
        """Tabulate the differences: of sequences that a class has seen, and of contexts.

        A sequence that neither class has seen goes to the shared counts in both, so that only
        the shares that its context leaves to them differ.
        """
        keys = np.union1d(self.toxic.keys, self.ordinary.keys)
        lower = np.full(len(keys), 1.0 / (1 << BITS))
        for length, counts in enumerate(self.shared, 1):
            lower = counts.interpolate(keys & ((1 << BITS * length) - 1), lower)
        self.seen = keys, np.log(self.toxic.interpolate(keys, lower)) - np.log(self.ordinary.interpolate(keys, lower))
        contexts = np.union1d(self.toxic.contexts, self.ordinary.contexts)
        self.left = contexts, np.log(self.toxic.share_left(contexts)) - np.log(self.ordinary.share_left(contexts))

    def differences(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under the toxic model less that under the ordinary one."""
        packed, lengths = sequences(words, self.ids)
        each = look_up(*self.seen, packed, np.nan)
        absent = np.flatnonzero(np.isnan(each))
        each[absent] = look_up(*self.left, packed[absent] >> BITS)
        return np.add.reduceat(each, np.concatenate(([0], np.cumsum(lengths)[:-1])))

    def scorer(self):
        """Texts -> ``inputs_of`` their words' differences; words met before are remembered."""
        known: dict[str, float] = {}

        def learn(words: set[str]):
            if words:
                new = list(words)
                known.update(zip(new, self.differences(new).tolist()))

        def score(texts: list[str]) -> np.ndarray:
            out = np.tile(inputs_of(np.zeros(1)), (len(texts), 1))
            at = 0
            while at < len(texts):
                # texts of about a million characters at a time
                if len(known) > REMEMBERED:
                    known.clear()
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < 1 << 20):
                    text = texts[at + len(part)]
                    size += len(text)
                    part.append(words_of(text))
                learn(set().union(*part).difference(known))
                for i, words in enumerate(part, at):
                    if words:
                        out[i] = inputs_of(np.fromiter(map(known.__getitem__, words), float, len(words)))
                at += len(part)
            return out

        return score

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ np.array(self.slopes) + self.offset, -30, 30)))


def fit_scale(inputs: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton steps, with a slight pull to zero; slopes are not negative."""
    spread = np.where(inputs.std(axis=0) > 0, inputs.std(axis=0), 1.0)
    used, slopes = list(range(inputs.shape[1])), np.zeros(inputs.shape[1])
    while True:
        x = np.column_stack([inputs[:, used] / spread[used], np.ones(len(inputs))])
        beta, pull = np.zeros(x.shape[1]), np.append(np.full(len(used), 1e-3), 1e-6) * len(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta += np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pull),
                                    x.T @ (weight * (toxic - p)) - pull * beta)
        wrong = [k for k, b in zip(used, beta) if b < 0]
        if not wrong:
            slopes[used] = beta[:-1] / spread[used]
            return tuple(slopes.tolist()), float(beta[-1])
        used = [k for k in used if k not in wrong]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> pd.DataFrame:
    """doc_id, toxic, part of labelled rows whose crc32(doc_id) mod 3 is not 1, at most
    ``per_class`` of a class (those least by a hash); and how many there are of each class."""
    code = crc32_of("doc_id")
    usable = labels.filter(code % 3 != 1).filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).withColumns({
            "rank": F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "part": (crc32_of("doc_id") / 3).cast("long") % 4})
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.filter(F.col("toxic") == k).orderBy("rank", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "toxic", "part").toPandas()
    chosen["weight"] = [counts[t] / max(1, (chosen.toxic == t).sum()) for t in chosen.toxic]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Models | None:
    """Models from the labelled rows; None where either class has no labelled text."""
    spark = docs.sparkSession
    chosen = labelled_sample(docs, labels, per_class)
    if chosen.toxic.nunique() < 2:
        return None
    ids = spark.createDataFrame(chosen[["doc_id", "toxic", "part", "weight"]])
    texts = Scratch(spark, "toxicity").write(docs.select("doc_id", whole_text().alias("text")).join(
        F.broadcast(ids), "doc_id"), "sample")  # at most 2 * per_class rows

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally = Counter("".join(batch.text).lower())
            yield pd.DataFrame({"c": list(tally), "n": list(tally.values())})

    letters = Counter({row["c"]: row["n"] for row in texts.select("text").mapInPandas(
        spell, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy("c").collect()})
    alphabet = {c: i + 4 for i, (c, _) in enumerate(letters.most_common(MOST_CHARACTERS))}
    model_rows = texts.filter("part <> 0") if (chosen[chosen.part != 0].toxic.nunique() == 2) else texts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, rows in batch.groupby("toxic"):
                tally = Counter(w for t in rows.text for w in words_of(t))
                if tally:
                    packed, lengths = sequences(list(tally), alphabet)
                    keys, values = summed(packed, np.repeat(list(tally.values()), lengths))
                    yield pd.DataFrame({"key": keys, "toxic": toxic, "n": values.astype("int64")})

    found = model_rows.select("text", "toxic").mapInPandas(count, "key long, toxic int, n long").groupBy(
        "key", "toxic").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    by_class = [Counts(part.key.to_numpy(), part.n.to_numpy(float))
                for part in (found[found.toxic == k] for k in (0, 1))]
    models = Models(alphabet, shared_counts(docs, alphabet, np.unique(found.key.to_numpy())),
                    by_class[1], by_class[0])
    models.compile()
    held = texts.filter("part = 0").select("text", "toxic", "weight")

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = models.scorer()
        for batch in batches:
            found = score(batch.text.tolist())
            yield pd.DataFrame({"ratio": found[:, 0], "excess": found[:, 1], "toxic": batch.toxic, "weight": batch.weight})

    models.shared, models.toxic, models.ordinary = [], None, None  # tasks need the tables alone
    scale = held.mapInPandas(differences, "ratio double, excess double, toxic int, weight double").toPandas()
    if scale.toxic.nunique() == 2:
        models.slopes, models.offset = fit_scale(
            scale[["ratio", "excess"]].to_numpy(), scale.toxic.to_numpy(float), (scale.weight / scale.weight.mean()).to_numpy())
    return models


def shared_counts(docs: DataFrame, ids: dict[str, int], needed: np.ndarray) -> list[Counts]:
    """Over all texts, how many different characters stand before sequences of one to
    ORDER - 1 characters.

    All sequences are counted, and with them the totals and kinds of their contexts, as tables;
    of these, the rows that score ``needed`` (the sequences of the labelled sample, so a bounded
    number) are returned.  A task sends a sequence of ORDER characters once, as long as it
    remembers it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "continuations")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            words = list({w for t in batch.text for w in words_of(t)})
            if words:
                keys = np.unique(sequences(words, ids)[0])
                new = np.setdiff1d(keys, seen, assume_unique=True)
                seen = np.union1d(seen, new) if len(seen) < MOST_SEEN else keys
                yield pd.DataFrame({"key": new})

    def only(table: DataFrame, keys: np.ndarray) -> pd.DataFrame:
        wanted = spark.createDataFrame(pd.DataFrame({"key": keys}), "key long")
        return table.join(F.broadcast(wanted), "key").toPandas().sort_values("key")

    longer, counts = docs.select(whole_text().alias("text")).mapInPandas(distinct, "key long").distinct(), []
    for length in range(ORDER - 1, 0, -1):
        suffix = (1 << BITS * length) - 1
        longer = scratch.write(longer.groupBy(F.col("key").bitwiseAND(F.lit(suffix)).alias("key")).agg(
            F.count(F.lit(1)).alias("n")), f"sequences{length}")
        before = longer.groupBy(F.shiftright("key", BITS).alias("key")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        keys = np.unique(needed & suffix)
        own, contexts = only(longer, keys), only(before, np.unique(keys >> BITS))
        counts.insert(0, Counts(own.key.to_numpy(np.int64), own.n.to_numpy(float), contexts.key.to_numpy(np.int64),
                                contexts.total.to_numpy(float), contexts.kinds.to_numpy(float)))
    return counts


def score_documents(docs: DataFrame, models: Models | None, *carried: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the ``carried`` columns.

    A text without words gets the score of a difference of zero; without models every score is 0.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = models.scorer() if models else None
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            values = models.probability(scorer(texts)) if models else np.zeros(len(texts))
            yield batch.drop_columns("_text").append_column("score", pa.array(values))

    narrow = docs.select("doc_id", *carried, whole_text().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInArrow(score, f"{schema}, score double").select(
        "doc_id", *carried, F.coalesce(crc32_of("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns from labels of rows whose crc32(doc_id as text) mod 3 is not 1; a row labelled both
    ways counts as toxic, null labels are left out.  Null texts count as empty.  Repeated rows
    are scored one by one; an empty table gives an empty result.  Label, language, source and
    doc_id are no inputs of a score.
    """
    return score_documents(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    models = fit(docs, labels)
    if models is None:
        return docs

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = models.scorer()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(models.probability(scorer(texts)) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)
