"""Small tables and brute-force counterparts for the tests of the text operators."""

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, partitions=3):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (
        texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def words(text):
    return (text or "").encode().lower().split()


def invented(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def slow_fingerprint(text, size=4):
    w = words(text)
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    """doc_id -> smallest doc_id reachable; ``prints`` is a dict doc_id -> fingerprint."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def rng():
    return np.random.default_rng(7)
