import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarterdeck.llm import toxicity
from tests.llm.helpers import docs, invented, rng

BAD = ["vile", "rotten", "filth", "wretch", "scoundrel"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = rng()
    texts, labels = {}, []
    for i in range(900):
        words = invented(r, int(r.integers(20, 300)), 800).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(words) // 25)):
                words[r.integers(len(words))] = BAD[r.integers(len(BAD))]
        texts[i] = " ".join(words)
        labels.append((i, 1, int(toxic)))
    texts |= {900: None, 901: "", 902: " \n", 903: "vile " * 20_000}
    labels += [(5, 0, 1), (6, None, None), (None, 1, 1)]
    label_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs(spark, texts), label_df, {i: t for i, _, t in labels[:900]}


def test_held_out_accuracy(spark, corpus):
    table, labels, truth = corpus
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    caught = [got[i].predicted for i in held if truth[i]]
    wrong = [got[i].predicted for i in held if not truth[i]]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.02
    assert got[900].score == got[901].score == got[902].score < 0.7 <= got[903].score


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    table, labels, _ = corpus
    from pyspark.sql import functions as F
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(table, x).collect())
              for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_no_labels_no_rows_and_clashing_columns(spark, corpus):
    table, labels, _ = corpus
    assert {r.score for r in toxicity.toxicity(table, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(table.limit(0), labels).count() == 0
    clash = table.limit(30).withColumn("toxic", table.doc_id).withColumn("score", table.text).withColumn(
        "weight", table.doc_id)
    assert toxicity.toxicity(clash, labels).count() == 30


def test_shares_of_a_context_sum_to_one():
    keys, lengths = toxicity.sequences(["abc", "abd", "ab", "b"], {"a": 4, "b": 5, "c": 6, "d": 7})
    assert len(keys) == lengths.sum() == 4 + 4 + 3 + 2
    counts = toxicity.Counts(*toxicity.summed(keys, np.ones(len(keys))))
    context = counts.contexts[counts.totals.argmax()]
    every = (context << toxicity.BITS) + np.arange(1 << toxicity.BITS)
    uniform = np.full(len(every), 1 / len(every))
    assert abs(counts.interpolate(every, uniform).sum() - 1) < 1e-9


@pytest.mark.parametrize("most_seen", [2_000_000, 0])
def test_shared_counts_cover_the_whole_corpus(spark, monkeypatch, most_seen):
    monkeypatch.setattr(toxicity, "MOST_SEEN", most_seen)
    r = rng()
    texts = [" ".join("".join("abcdefgh"[x] for x in r.integers(0, 8, int(n))) for n in r.integers(1, 9, 40))
             for _ in range(50)]
    ids = {c: i + 4 for i, c in enumerate("abcdefgh")}
    needed = np.unique(toxicity.sequences(toxicity.words_of(texts[0]), ids)[0])
    got = toxicity.shared_counts(docs(spark, texts), ids, needed)
    keys = np.unique(toxicity.sequences([w for t in texts for w in toxicity.words_of(t)], ids)[0])
    for length in range(toxicity.ORDER - 1, 0, -1):
        suffix = (1 << toxicity.BITS * length) - 1
        full = toxicity.Counts(*toxicity.summed(keys & suffix, np.ones(len(keys))))
        keys, mine, wanted = full.keys, got[length - 1], np.unique(needed & suffix)
        assert mine.keys.tolist() == wanted.tolist()
        assert mine.values.tolist() == toxicity.look_up(full.keys, full.values, wanted).tolist()
        before = np.unique(wanted >> toxicity.BITS)
        assert mine.contexts.tolist() == before.tolist()
        assert mine.totals.tolist() == toxicity.look_up(full.contexts, full.totals, before).tolist()
        assert mine.kinds.tolist() == toxicity.look_up(full.contexts, full.kinds, before).tolist()
        lower = np.full(len(wanted), 0.1)
        assert np.allclose(mine.interpolate(wanted, lower), full.interpolate(wanted, lower))


def test_scores_are_those_of_models_written_out(spark, corpus):
    table, labels, _ = corpus
    models = toxicity.fit(table, labels)
    chosen = toxicity.labelled_sample(table, labels, toxicity.SAMPLE_PER_CLASS)
    text = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}

    def spelt(word):
        symbols = [1] * 4 + [models.ids.get(c, 3) for c in toxicity.NOT_SPELT.sub("", word)] + [2]
        return [tuple(symbols[i - 4:i + 1]) for i in range(4, len(symbols))]

    def by_context(counts):
        context = defaultdict(dict)
        for sequence, n in counts.items():
            context[sequence[:-1]][sequence[-1]] = n
        return context

    own = [by_context(Counter(s for d, t, part in zip(chosen.doc_id, chosen.toxic, chosen.part) if part and t == k
                              for w in toxicity.words_of(text[d]) for s in spelt(w))) for k in (0, 1)]
    longer, shared = {s for t in text.values() for w in toxicity.words_of(t) for s in spelt(w)}, {}
    for length in (4, 3, 2, 1):
        counts = Counter(s[1:] for s in longer)
        shared[length], longer = by_context(counts), set(counts)

    def probability(sequence, k):
        p = 1 / (1 << toxicity.BITS)
        for length in (1, 2, 3, 4, 5):
            follow = (own[k] if length == 5 else shared[length]).get(sequence[5 - length:-1], {})
            if follow:
                d = toxicity.DISCOUNT
                p = (max(follow.get(sequence[-1], 0) - d, 0) + d * len(follow) * p) / sum(follow.values())
        return p

    def difference(word):
        return sum(math.log(probability(s, 1)) - math.log(probability(s, 0)) for s in spelt(word))

    got = {r.doc_id: r.score for r in toxicity.toxicity(table, labels).collect()}
    assert min(models.slopes) >= 0 < max(models.slopes)
    for d in [*range(0, 60), 901, 903]:
        each = [difference(w) for w in toxicity.words_of(text[d])[:400]] or [0.0]
        ratio = sum(math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(x)) for x in each) / len(each)
        excess = math.log(toxicity.FLOOR + sum(max(x - toxicity.MARGIN, 0) for x in each) / len(each))
        score = models.slopes[0] * ratio + models.slopes[1] * excess + models.offset
        assert abs(got[d] - 1 / (1 + math.exp(-max(-30, min(30, score))))) < 1e-6


def test_words_for_the_ordinary_class_count():
    one, more = toxicity.inputs_of(np.array([5.0, 0.0])), toxicity.inputs_of(np.array([5.0, -5.0]))
    assert more[0] < one[0] and more[1] == one[1]


def test_slopes_are_not_negative():
    r = rng()
    toxic = (r.random(500) < 0.4).astype(float)
    inputs = np.column_stack([-toxic + r.normal(size=500), toxic + r.normal(size=500)])
    slopes, offset = toxicity.fit_scale(inputs, toxic, np.ones(500))
    assert slopes[0] == 0 < slopes[1] and offset < 0
    assert toxicity.fit_scale(-inputs * [0, 1], toxic, np.ones(500))[0] == (0.0, 0.0)
