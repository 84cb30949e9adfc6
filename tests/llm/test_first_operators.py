import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarterdeck.llm import exact_dedup, packing, simhash_dedup, url_filter
from quarterdeck.llm.components import connected_components
from quarterdeck.llm.queries import RULES
from tests.llm.helpers import DOCS, docs, invented, rng, slow_components, slow_fingerprint


def test_exact_dedup_matches_brute_force(spark):
    r = rng()
    long = invented(r, 30_000)
    texts = [None, "", " ", "\t\n", "a", "a ", "a\n", "b" * 48, "b" * 48, "b" * 49, "b" * 432, "b" * 432,
             "b" * 433, long, long + "x", long, "é\x0bz", "é z", *["hot  copy " * 9] * 60, *["hot copy\t" * 9] * 30]
    got = {row.doc_id: row for row in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(texts)
    for text, members in groups.items():
        for i in members:
            row = got[i]
            assert (row.keep_id, row.group_size, row.kept) == (members[0], len(members), i == members[0])
            assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "z"), (2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted(
        [("1", "1", 3), ("1", "1", 3), ("1", "1", 2), ("None", "1", 3), ("None", "None", 1), ("2", "1", 2)])
    assert sum(r.kept for r in got) == 3
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    clash = df.withColumn("n", df.doc_id).withColumn("head", df.text).withColumn("parent", df.doc_id)
    assert exact_dedup.exact_dedup(clash).count() == 6


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter_matches_brute_force(spark):
    urls = [None, "", "x", "http://", "http://com/", "http://com", "http://a.COM/x?y#z", "http://xcom/",
            "http://www.example.com/en/1", "http://Example.com/en/1", "http://m.example.com/en",
            "http://badexample.com/en/2", "http://a.net/es/", "http://a.net/fr/x", "http://net/fr/",
            "http://a.net/de/", "a://b.net/es/://c", "http://www.example.com?/en/", "http://x.net#/es/",
            "http://com.evil/en/", *["http://hot.net/es/1"] * 50]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)],
                               "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, RULES).collect()}
    for i, u in enumerate(urls):
        assert tuple(got[i])[1:] == slow_verdict(u), u
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_url_rule_index_uses_the_rarest_token():
    index = url_filter.build_index(RULES, {"com": 9, "net": 5, "example": 3, "en": 4, "es": 2, "fr": 7, "www": 1})
    assert {k: [r.name for r in v] for k, v in index.items()} == {
        "com": ["com/"], "example": ["example.com/en/"], "www": ["www.example.com/en/"],
        "es": ["net/es/"], "net": ["net/fr/"]}


def near_copies(r, base, n):
    w = base.split()
    out = []
    for _ in range(n):
        v = list(w)
        v[r.integers(len(v))] = f"new{r.integers(99)}"
        out.append(" ".join(v))
    return out


def test_simhash_matches_brute_force(spark):
    r = rng()
    base, other = invented(r, 300), invented(r, 500)
    texts = [None, "", " \t", "one", "One two", "a b c d", "A B C D", "a b c d e", *near_copies(r, base, 40),
             *near_copies(r, other, 25), *[invented(r, 60) for _ in range(40)], *[base] * 30, "É é É é É",
             invented(r, 20_000)]
    expected = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    classes = slow_components(expected)
    got = simhash_dedup.simhash_dedup(docs(spark, texts)).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {i: f"{f:016x}" for i, f in expected.items()}
    assert {x.doc_id: x.component_id for x in got} == classes
    assert len(set(classes.values())) > 40
    assert simhash_dedup.simhash_dedup(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("count", [10, 10_000_000, 10 ** 9, 10 ** 11])
def test_pairs_within_the_radius_share_a_key_at_any_size(count):
    r = rng()
    x = r.integers(0, 2 ** 63, 200, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in r.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    slices = simhash_dedup.slices_for(count)
    assert (simhash_dedup.keys_of(x, slices) == simhash_dedup.keys_of(y, slices)).any(axis=1).all()


def test_large_keys_are_split_into_pairs_of_chunks(spark):
    r = rng()
    bases = r.integers(0, 2 ** 63, 5, dtype=np.uint64)
    values = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in bases for i, j in r.integers(0, 63, (60, 2))}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    df = spark.createDataFrame(signed, "fingerprint long").repartition(4)
    edges = simhash_dedup.links(df, len(signed), chunk=16)
    roots = {x.node: x.root for x in connected_components(edges).collect()}
    expected = slow_components({v[0]: v[0] & (1 << 64) - 1 for v in signed})
    assert {v[0]: roots.get(v[0], v[0]) for v in signed} == expected


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {x.node: x.root for x in connected_components(
        spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert set(got) == {*range(100, 161), 7, *range(200, 260)}
    assert all(v == (100 if 100 <= k <= 160 else 7) for k, v in got.items())


def test_packing_is_an_exact_cut(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = rng()
    texts = [None, "", "a", "it's  <|endoftext|> don't\n\n x", "Ünï ² 三 \u00a0z", invented(r, 5000), " lead", "x" * 3000]
    got = packing.pack(docs(spark, texts)).collect()
    assert len({x.sequence_id for x in got}) == len(got) and {x.offset for x in got} == {0}
    by = defaultdict(list)
    for x in got:
        assert x.length & (x.length - 1) == 0 and x.length <= 1024 == packing.LIMIT
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
        by[x.doc_id].append(x)
    for i, t in enumerate(texts):
        pieces = sorted(by[i], key=lambda x: x.start)
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert [v for p in pieces for v in p.ids] == ids
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "x y", 3), (1, "x y", 3)], "doc_id long, text string, length long")
    assert packing.pack(repeated).groupBy("start").count().filter("count = 2").count() == 2


def test_clashing_columns_do_not_matter(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None])
    for name in ("fingerprint", "component_id", "key", "members", "ids", "length", "start", "kept", "row_id"):
        df = df.withColumn(name, df.doc_id)
    assert simhash_dedup.simhash_dedup(df).count() == 3
    assert packing.pack(df, with_ids=False).columns[:2] == ["doc_id", "start"]
    assert exact_dedup.exact_dedup(df).filter("kept").count() == 2
    assert DOCS


def test_search_by_rows_finds_what_the_matrix_finds(monkeypatch):
    r = rng()
    bases = r.integers(0, 2 ** 63, 30, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 63, (30, 20), dtype=np.uint64)
    prints = np.unique((bases[:, None] ^ flips ^ np.roll(flips, 1, axis=1)).ravel())

    def classes(edges):
        hub = dict(zip(edges[0].tolist(), edges[1].tolist()))
        groups = defaultdict(set)
        for v in prints.tolist():
            groups[hub.get(v, v)].add(v)
        return sorted(map(sorted, groups.values()))

    matrix = classes(simhash_dedup.forest(prints))
    monkeypatch.setattr(simhash_dedup, "MATRIX", 0)
    assert classes(simhash_dedup.forest(prints)) == matrix and 1 < len(matrix) < len(prints)
