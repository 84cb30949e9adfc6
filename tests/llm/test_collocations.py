"""Collocations against a count of every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarterdeck.llm import collocations as module
from quarterdeck.llm import token_blocks
from quarterdeck.llm.collocations import collocations
from tests.llm.helpers import docs, rng


def slow_collocations(rows, threshold, top=2000, longest=5, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode()):
            words = re.findall(rb"[^\x20\x09]+", piece.lower())
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in good.items():
            if any(share * a <= 100 * b and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in good.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def found(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def invented_rows(seed):
    r = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(30)] + ["De", "la", "é"])
    p = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(150):
        words = list(r.choice(vocabulary, int(r.integers(0, 80)), p=p / p.sum()))
        if i % 3 == 0:
            words[2:2] = ["once", "upon", "a", "time", "there", "was"]
        text = "".join(w + str(r.choice([" ", "\t", "  ", ". ", ", ", "\r\n"], p=[.8, .05, .05, .05, .03, .02])) for w in words)
        rows.append((["en", "de", None][int(r.integers(0, 3))], text))
    return rows + [("en", None), ("en", ""), ("fr", "!?."), ("und", "a b a b a b " * 40), ("en", "x x x x x x x x " * 30)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("shards, threshold", [(1, 5), (3, 8), (4, 20)])
def test_equals_a_count_of_every_phrase(spark, shards, threshold):
    rows = invented_rows(shards)
    got = collocations(table(spark, rows), threshold, shards=shards, block_words=300)
    assert found(got) == slow_collocations(rows, threshold)


def test_full_table_and_small_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "TABLE_BITS", 4)
    monkeypatch.setattr(token_blocks, "BUCKET_KEYS", 50)
    rows = invented_rows(9)
    assert found(collocations(table(spark, rows), 10, shards=3, block_words=200)) == slow_collocations(rows, 10)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_entries_that_another_phrase_took_early_lose_no_phrase(spark, monkeypatch, seed):
    monkeypatch.setattr(module, "TABLE_BITS", 9)
    rows = invented_rows(seed)
    assert found(collocations(table(spark, rows), 8, shards=2, block_words=300)) == slow_collocations(rows, 8)


def test_phrases_that_become_frequent_late_are_counted_from_the_start(spark):
    # one block per text and shards by chance: whichever comes last, all of a phrase is counted
    rows = [("en", "alpha beta gamma delta")] * 12 + [("en", f"q{i} alpha beta") for i in range(9)]
    got = collocations(table(spark, rows), 12, shards=4, block_words=1)
    assert found(got) == slow_collocations(rows, 12)


def test_products_beyond_64_bits_and_part_shares(spark):
    counts = spark.createDataFrame(
        [("en", "a b", 2, 9_000_000_000_001), ("en", "a", 1, 9_100_000_000_003), ("en", "b", 1, 9_000_000_000_007)],
        "lang string, phrase string, size long, a long")
    totals = spark.createDataFrame([("en", 16_000_000_000_000_003)], "lang string, n long")
    row = module.scored(counts, totals, 5).first()
    assert row["score"] == 1000 * 9_000_000_000_001 * 16_000_000_000_000_003 // (9_100_000_000_003 * 9_000_000_000_007)
    rows = [("en", "a b c")] * 9 + [("en", "a b")]
    got = found(collocations(table(spark, rows), 5, share=90))
    assert got == slow_collocations(rows, 5, share=90) and {r[2] for r in got} == {"a b c"}
    assert {r[2] for r in found(collocations(table(spark, rows), 5))} == {"a b c", "a b"}


def test_ranks_empty_table_and_clashing_columns(spark):
    rows = [("en", "a b. c d. e f. " * 20)]
    got = found(collocations(table(spark, rows), 5, top=2))
    assert got == slow_collocations(rows, 5, top=2) and len(got) == 2
    assert collocations(docs(spark, {})).count() == 0
    clash = spark.createDataFrame([("en", "a b", 1, 2, "x")] * 7, "lang string, text string, n int, rank int, phrase string")
    assert {r["phrase"] for r in collocations(clash, 5).collect()} == {"a b"}


def test_very_long_text(spark):
    r = rng()
    text = " ".join(f"w{x}" for x in r.integers(0, 15, 120_000))
    assert found(collocations(table(spark, [("en", text)]), 500)) == slow_collocations([("en", text)], 500)


def test_a_scan_tells_the_next_only_sums_of_what_is_under_way(spark):
    """Entries of phrases that reach the threshold; the others' sums once, none of what began a cycle ago."""
    keys = np.array([1 << 60, 2 << 60, 3 << 60], np.uint64)

    def sent(began, *counts):
        _, n, packed, number = next(token_blocks.deal(keys, np.array(counts), 1))
        return 1, n, packed, number, began

    rows = spark.createDataFrame([sent(1, 5, 1, 1), sent(1, 5, 2, 0)], token_blocks.ddl(module.BEGUN))
    told = module.judged(rows, 10, 1, 2, 1).collect()
    assert [(x.n, x.entry) for x in told if x.entry is not None] == [(1, (1 << 60) >> (64 - module.TABLE_BITS))]
    (left,) = [x for x in told if x.entry is None]
    assert left.began == 1 and token_blocks.dealt_keys(left["keys"], left.n).tolist() == keys[1:].tolist()
    assert token_blocks.unpacked(left.counts, left.n, token_blocks.COUNT).tolist() == [3, 1]
    done = module.judged(rows, 10, 2, 2, 1).collect()
    assert all(x.entry is not None for x in done)
