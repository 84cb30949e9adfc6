from collections import Counter

import numpy as np

from quarterdeck.llm import decontaminate as D
from tests.llm.helpers import docs, invented, rng


def slow_leaks(texts, items):
    out = {}
    for i, text in enumerate(texts):
        words = D.WORD.findall((text or "").lower())
        for item, item_text in items.items():
            own = D.WORD.findall((item_text or "").lower())
            if not own:
                continue
            width = min(5, len(own))
            grams = lambda w: Counter(tuple(w[k:k + width]) for k in range(len(w) - width + 1))
            wanted = grams(own)
            best = max((sum((grams(words[a:a + len(own)]) & wanted).values()) / wanted.total()
                        for a in range(len(words) - len(own) + 1)), default=0)
            if best >= 0.8:
                out[i, item] = round(best, 9)
    return out


def test_leaks_match_brute_force(spark):
    r = rng()
    items = {i: invented(r, int(n), 300) for i, n in enumerate(r.integers(6, 60, 25))}
    items |= {100: "Only three words", 101: "", 102: None, 103: "x x x x x x x x", 104: items[3] + " tail"}
    texts = [None, "", "only THREE, words!", "only three", "x " * 7, "x " * 8, "x " * 300]
    for i in range(25):
        own = items[i].split()
        texts.append(" ".join([invented(r, 40, 300), items[i].upper(), invented(r, 30, 300)]))
        edited = list(own)
        edited[int(r.integers(len(edited)))] = "edited"
        texts.append(" ".join([invented(r, 20, 300), *edited, "end"]))
        cut = own[:int(len(own) * r.uniform(0.6, 1))]
        texts.append(" ".join([*cut, invented(r, 50, 300)]))
    texts += [invented(r, 30_000, 300)] + [items[7]] * 30
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    table = docs(spark, texts)
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in D.leaks(table, benchmark).collect()}
    assert got == slow_leaks(texts, items)
    left = {x.doc_id for x in D.without_leaks(table, benchmark).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in got}
    assert D.without_leaks(table, benchmark).columns == table.columns
    assert D.leaks(table.limit(0), benchmark).count() == 0
    assert D.leaks(table, benchmark.limit(0)).count() == 0
    clash = table.withColumn("item_id", table.doc_id).withColumn("_x", table.doc_id)
    assert D.leaks(clash, benchmark).count() == len(got)


def test_block_index_returns_all_within_the_radius():
    r = rng()
    prints = r.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    index = D.BlockIndex(prints)
    for wanted in prints[:20]:
        wanted ^= np.uint64(r.integers(0, 2 ** 20))
        assert index.within(wanted).tolist() == np.flatnonzero(np.bitwise_count(prints ^ wanted) <= D.RADIUS).tolist()


def test_documents_shorter_than_an_item():
    r = rng()
    items = {i: invented(r, int(n), 4000) for i, n in enumerate(r.integers(12, 80, 30))} | {50: "a b c d e"}
    matcher = D.Matcher(items)
    for i, text in items.items():
        w = text.split()
        short = {"short of the last word": w[:-1], "short of the first": w[1:], "one left out": w[:9] + w[10:],
                 "half": w[:len(w) // 2]}
        for name, own in short.items():
            grams = [{tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (own, w)]
            share = len(grams[0] & grams[1]) / len(grams[1])
            expected = [(i, share, 0, len(own))] if share >= 0.8 and own != w else []
            if own != w:
                assert matcher.find(" ".join(own)) == expected, name
