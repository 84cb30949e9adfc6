import hashlib
from collections import Counter

import numpy as np
import pytest

from quarterdeck.llm import suffix_dedup
from quarterdeck.llm.suffix_order import suffix_order
from tests.llm.helpers import docs, invented, rng


def test_suffix_order_matches_sorting():
    r = rng()
    for _ in range(1500):
        a = r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 50)))
        assert suffix_order(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def slow_removal(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for number, d in enumerate(data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[number] = (len(d), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()),
                       hashlib.sha256(kept).hexdigest())
    return out


def corpus(r):
    passage, other = invented(r, 120), invented(r, 60)
    base = invented(r, 700)
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 201, "é" * 300, "ab" * 500, passage, passage, base]
    for _ in range(25):  # an edited copy each
        words = base.split()
        words[int(r.integers(len(words)))] = f"edit{r.integers(1000)}"
        texts.append(" ".join(words))
    for _ in range(60):  # a passage in other surroundings, whole or cut
        a, b = sorted(r.integers(0, len(passage), 2))
        texts.append(" ".join([invented(r, int(r.integers(0, 60))), passage, invented(r, int(r.integers(0, 60)))]))
        texts.append(" ".join([invented(r, 20), passage[a:b], invented(r, 20), other[:int(r.integers(150, 260))]]))
    texts += [f"{other}{other} {invented(r, 10)}" for _ in range(5)] + [invented(r, 300) for _ in range(30)]
    texts += [passage[:200] + "!", "?" + passage[:200], passage[5:204], passage[5:205] + "-"]
    return texts


@pytest.mark.parametrize("group, segment", [(256, 1 << 21), (4, 1000)])
def test_removal_matches_brute_force(spark, monkeypatch, group, segment):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    texts = corpus(rng())
    expected = slow_removal(texts)
    rows = suffix_dedup.remove_repeats(docs(spark, texts)).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows}
    assert len(rows) == len(texts) and got == expected
    for x in rows:
        assert hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 and len(x.spans) == x.n_spans


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    long, short = "abc " * 60, "abc"
    rows = [(1, long, 0), (1, long, 0), (2, short, 0), (2, short, 0), (None, "q" * 250 + "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    df = df.withColumn("row_id", df.doc_id).withColumn("key", df.text)
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans) for x in
                 suffix_dedup.remove_repeats(df, with_kept=False).collect())
    assert got == [(0, 251, 250, 1), (1, 240, 240, 1), (1, 240, 240, 1), (2, 3, 0, 0), (2, 3, 0, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_many_equal_rows_are_compared_once(spark):
    from pyspark.sql import functions as F
    long = invented(rng(), 120)
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(long).alias("text"))
    few = spark.createDataFrame([(8, f"own start {long[:400]}"), (9, "alone " * 20)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(many.unionByName(few), with_kept=False).groupBy(
        "doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(7, len(long), len(long), 1, 20_000), (8, 410, 400, 1, 1), (9, 120, 0, 0, 1)]
