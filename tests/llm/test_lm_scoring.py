"""Scores of the backoff automaton against the smoothing formula, applied token by token."""

import math
import zlib
from collections import Counter

import pytest

from quarterdeck.llm import token_blocks
from quarterdeck.llm.lm_scoring import STRENGTH, score_texts
from tests.llm.helpers import docs, invented, rng

START, END = b"\n\n", b"\n"


def model(texts, order, strength):
    tokens = {i: (t or "").encode().lower().split() + [END] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter()
    for i, words in tokens.items():
        if not held[i]:
            padded = [START] + words
            counts.update((w,) for w in padded)
            for n in range(2, order + 1):
                counts.update(tuple(padded[k:k + n]) for k in range(len(padded) - n + 1))
    total = sum(len(t) for i, t in tokens.items() if not held[i])
    kinds = len({w for i, t in tokens.items() if not held[i] for w in t})

    def share(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + kinds + 1)
        pull = strength[len(gram)]
        return (counts[gram] + pull * share(gram[1:])) / (counts[gram[:-1]] + pull)

    return counts, (tokens, held, total), share


def slow_scores(texts, order=3, strength=STRENGTH):
    counts, (tokens, held, total), share = model(texts, order, strength)
    out = {}
    for i, words in tokens.items():
        padded = [START] + words
        score = sum(math.log10(share(tuple(padded[max(0, k - order + 1):k + 1]))) for k in range(1, len(padded)))
        base = sum(math.log10(share((w,))) for w in words)
        out[i] = (held[i], len(words), sum(counts[(w,)] > 0 for w in words), total, base, score)
    return out


def check(df, texts, **options):
    want = slow_scores(texts, **options)
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
           for r in df.collect()}
    assert set(got) == set(want)
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_follow_the_formula(spark, order):
    r = rng()
    texts = {i: invented(r, int(r.integers(0, 60)), 40) for i in range(120)}
    texts.update({200: None, 201: "", 202: "  \t ", 203: "W1 w2 unheard", 204: texts[3], 205: "w1 " * 3000})
    check(score_texts(docs(spark, texts), order=order, block_words=500), texts, order=order)


def test_many_buckets(spark, monkeypatch):
    r = rng()
    texts = {i: invented(r, 40, 200) for i in range(60)}
    monkeypatch.setattr(token_blocks, "BUCKET_KEYS", 100)
    check(score_texts(docs(spark, texts), block_words=300), texts)


def test_shares_of_all_words_add_up_to_one():
    counts, _, share = model({i: t for i, t in enumerate(["a b a", "b a c", "a a b", "c", "b b"])}, 3, STRENGTH)
    kinds = {g[0] for g in counts if len(g) == 1} - {START} | {b"unheard"}
    for before in ((), (b"a",), (b"a", b"b"), (START,), (START, b"a"), (b"unheard", b"a")):
        assert sum(share(before + (w,)) for w in kinds) == pytest.approx(1)


def test_held_out_texts_do_not_train(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    other = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2)
    found = {r["doc_id"]: r for r in score_texts(docs(spark, {held: "x y z", other: "p q"})).collect()}
    assert found[held]["n_known"] == 1 and found[held]["n_tokens"] == 4 and found[held]["train_tokens"] == 3
    assert found[other]["score"] > found[other]["base_score"]


def test_empty_table_no_training_texts_and_clashing_columns(spark):
    assert score_texts(docs(spark, {})).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_texts(docs(spark, {held: "x y"})).first()
    assert (row["train_tokens"], row["n_known"]) == (0, 0) and row["score"] == pytest.approx(row["base_score"])
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 1, None)],
                                  "doc_id long, text string, score int, block string")
    rows = score_texts(clash).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == [(-1, 1), (1, 3), (1, 3)]
