import numpy as np

import corpus_pipeline
from quarterdeck.llm import near_copies
from quarterdeck.llm.scratch import Scratch
from tests.llm.helpers import docs, invented, rng, words


def slow_classes(texts, similarity=0.8):
    """doc_id -> smallest doc_id reachable by pairs of a Jaccard similarity of five-word shingles."""
    sets = {}
    for i, text in texts.items():
        w = words(text)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    classes = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9):
                old, new = max(classes[i], classes[j]), min(classes[i], classes[j])
                classes = {k: new if c == old else c for k, c in classes.items()}
    return classes


def corpus():
    r = rng()
    texts = [None, "", " ", "one", "One", "one two three four", "a b c d e", "A  b c d e"]
    notice = invented(r, 60)
    for size in (9, 30, 200, 400, 2000):
        base = invented(r, size).split()
        for edits in (0, *range(1, 12)):
            own = list(base)
            for at in r.choice(size, min(edits * max(1, size // 200), size), replace=False):
                own[at] = f"new{r.integers(10 ** 6)}"
            texts.append(" ".join(own))
        texts += [" ".join(base[size // 7:]), " ".join(base + invented(r, size // 5).split())]
    texts += [f"{notice} {invented(r, int(n))}" for n in r.integers(10, 120, 60)]
    return texts


def test_near_copies_match_jaccard_brute_force(spark, monkeypatch):
    texts = dict(enumerate(corpus()))
    expected = slow_classes(texts)
    assert 60 < len(set(expected.values())) < len(texts) - 20
    table = docs(spark, texts)
    assert dict(near_copies.near_copies(table).collect()) == expected
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    monkeypatch.setattr(near_copies, "SAMPLE", 0.0)  # the order of shingles changes nothing
    assert dict(near_copies.near_copies(table).collect()) == expected
    left = corpus_pipeline.drop_near_copies(spark, table, "")
    assert {x.doc_id for x in left.collect()} == set(expected.values()) and left.columns == table.columns


def test_bound_keeps_every_pair_that_reaches():
    r = rng()
    for _ in range(300):
        n = int(r.integers(1, 60))
        one = np.sort(r.choice(200, n, replace=False))
        two = np.sort(np.unique(np.concatenate((one[r.random(n) < 0.95], r.choice(200, int(r.integers(0, 6)))))))
        shared = np.intersect1d(one, two)
        if len(shared) < 0.8 * len(np.union1d(one, two)) or not len(two):
            continue
        for value in shared:
            assert near_copies.may_reach(len(one), np.searchsorted(one, value), len(two),
                                         np.searchsorted(two, value), 0.8)


def test_odd_tables(spark):
    texts = docs(spark, {1: "a b c d e f", 2: "a b c d e f"})
    odd = texts.union(texts).union(spark.createDataFrame([(None, "a b c d e f", "", "", 0)], texts.schema))
    assert [x.doc_id for x in near_copies.without_near_copies(odd).orderBy("doc_id").collect()] == [None, 1, 1]
    assert near_copies.near_copies(texts.limit(0)).count() == 0


def test_texts_of_one_id_are_judged_one_by_one(spark):
    r = rng()
    w, other = invented(r, 40), invented(r, 40)
    table = spark.createDataFrame([(1, w, 1), (5, w + " tail", 2), (5, other, 3)], "doc_id long, text string, _row int")
    left = near_copies.without_near_copies(table)
    assert left.columns == table.columns
    assert {(x.doc_id, x.text) for x in left.collect()} == {(1, w), (5, other)}


def test_bitmaps_never_rule_out_what_sets_share():
    r = rng()
    for _ in range(300):
        one = np.unique(r.integers(0, 1 << 63, int(r.integers(0, 400))).astype(np.uint64))
        kept = one[r.random(len(one)) < r.random()]
        two = np.unique(np.concatenate((kept, r.integers(0, 1 << 63, int(r.integers(0, 400))).astype(np.uint64))))
        bound = near_copies.most_shared(near_copies.bitmap_of(one), len(one), near_copies.bitmap_of(two), len(two))
        assert len(np.intersect1d(one, two)) <= bound <= min(len(one), len(two))


def test_bitmaps_of_many_pairs_tell_the_same_as_of_one():
    r = rng()
    sets = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in r.integers(0, 300, 20)]
    sets += [np.unique(np.concatenate((s[: len(s) // 2], sets[0]))) for s in sets]
    bits = np.array([near_copies.bitmap_of(s) for s in sets], object)
    sizes = np.array([len(s) for s in sets])
    i, j = np.nonzero(np.ones((len(sets), len(sets)), bool))
    got = near_copies.Bitmaps(bits).most_shared(i, j, sizes[i], sizes[j])
    assert got.tolist() == [near_copies.most_shared(bits[a], sizes[a], bits[b], sizes[b]) for a, b in zip(i, j)]


def test_a_group_that_stays_apart_makes_few_pairs(spark):
    """Copies of one text with other edits each share keys, but no two reach the similarity."""
    r = rng()
    base, texts = invented(r, 150).split(), []
    for k in range(120):
        own = list(base)
        for at in r.choice(150, 6, replace=False):
            own[at] = f"new{k}-{at}"
        texts.append(" ".join(own))
    expected = slow_classes(dict(enumerate(texts)))
    assert len(set(expected.values())) > 100
    table = docs(spark, texts)
    prints = near_copies.with_keys(table, 5, 0.8).cache()
    members = near_copies.shared_keys(prints).selectExpr("key", "node", "node AS root", "size", "place").join(
        prints.select("node", "bits"), "node")
    # all pairs of the group are 7,140, each under many keys
    assert near_copies.pairs_within(members, 0.8).select("a", "b").distinct().count() < 200
    assert dict(near_copies.near_copies(table).collect()) == expected


def test_first_pairs_are_those_of_the_distance_tables(spark):
    r = rng()
    base = invented(r, 400).split()
    texts = [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(reversed(base)), invented(r, 300), ""]
    prints = near_copies.with_keys(docs(spark, texts), 5, 0.8)
    of_doc = {x.doc_id: x for x in prints.collect()}
    close = {tuple(sorted((of_doc[a].node, of_doc[b].node))) for a in of_doc for b in of_doc if a < b and (
        (of_doc[a].fingerprint ^ of_doc[b].fingerprint) & (1 << 64) - 1).bit_count() <= near_copies.RADIUS}
    nodes = prints.select("node", "fingerprint").distinct()
    found = near_copies.by_fingerprint(nodes, near_copies.RADIUS, Scratch(spark, "test"))
    assert close and {tuple(x) for x in found.collect()} == close


def test_keys_with_few_pairs_send_no_bitmaps(spark, monkeypatch):
    """Long texts that share a passage and stay apart: every key has two or three members."""
    r = rng()
    texts = []
    for _ in range(6):
        passage = invented(r, 60, 10 ** 6)
        texts += [f"{passage} {invented(r, int(n), 10 ** 6)}" for n in (300, 310, 320)]
    table, seen, within = docs(spark, texts), [], near_copies.pairs_within

    def counted(members, similarity):
        seen.append(members.count())
        return within(members, similarity)

    monkeypatch.setattr(near_copies, "pairs_within", counted)
    expected = slow_classes(dict(enumerate(texts)))
    assert dict(near_copies.near_copies(table).collect()) == expected and seen == [0]


def test_keys_with_many_pairs_are_compared_by_folded_bitmaps(spark, monkeypatch):
    texts = dict(enumerate(corpus()))
    monkeypatch.setattr(near_copies, "PAIRS_A_MEMBER", 0)
    monkeypatch.setattr(near_copies, "BITMAP_BYTES", 16)
    assert dict(near_copies.near_copies(docs(spark, texts)).collect()) == slow_classes(texts)
