from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import quality, sharding, site_tree
from quarterdeck.llm.scratch import Scratch
from tests.llm.helpers import docs, invented, rng


def test_shards_do_not_depend_on_how_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    table = docs(spark, [f"text {i % 40} " * (i % 40) for i in range(200)]).withColumn("doc_id", F.col("doc_id") % 40)
    found = [sorted(map(tuple, sharding.shard(x, 3000).collect())) for x in (
        table.coalesce(1), table.repartition(5, "text"), table.orderBy(F.desc("doc_id")))]
    assert len(found[0]) == 200 and found[0] == found[1] == found[2]
    # equal rows are told apart, and what no bit splits any more is still placed
    monkeypatch.setattr(sharding, "MOST_BITS", 2)
    few = sharding.shard(docs(spark, ["x" * 900] * 60).withColumn("doc_id", F.lit(1)), 1000).collect()
    assert len(few) == 60 and len({x.shard for x in few}) == 60 and {x.shard_bytes for x in few} == {900}


def test_shards_fit_and_only_oversized_buckets_split(spark):
    r = rng()
    texts = [None, "", *[invented(r, int(n)) for n in r.integers(1, 400, 400)], "x" * 50_000, "é" * 3000]
    limit = 6000
    got = sharding.shard(docs(spark, texts), limit).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    assert all(x.n_bytes == len((texts[x.doc_id] or "").encode()) for x in got)
    shards = {}
    for x in got:
        shards.setdefault(x.shard, []).append(x)
    for name, members in shards.items():
        size = sum(x.n_bytes for x in members)
        assert {(x.shard_bytes, x.shard_docs) for x in members} == {(size, len(members))}
        assert size <= limit or (len(members) == 1 and name.startswith("large-"))
    names = [n for n in shards if not n.startswith("large-")]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for name in names:  # its parent was too large: all below the parent together exceed the limit
        parent = name[:-1]
        assert sum(x.n_bytes for n in names if n.startswith(parent) for x in shards[n]) > limit
    assert {x.shard for x in sharding.shard(docs(spark, texts[:20])).collect()} == {""}
    assert sharding.shard(docs(spark, texts).limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "x" * 100)] * 300, "doc_id long, text string").repartition(3)
    split = sharding.shard(repeated.withColumn("shard", repeated.doc_id), 1000)
    assert split.count() == 300 and split.agg({"shard_bytes": "max"}).first()[0] <= 1000


def test_quality_prefers_texts_like_the_target(spark):
    r = rng()
    good = [invented(r, int(n), 400) for n in r.integers(30, 200, 400)]
    junk = [" ".join(f"z{x} ###" for x in r.integers(0, 60, int(n))) for n in r.integers(30, 200, 100)]
    texts = good + junk + [None, "", "  "]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 500, 2)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    table = docs(spark, texts)
    got = {x.doc_id: x for x in quality.quality(table, labels).collect()}
    assert len(got) == 503
    assert sum(x.kept for x in got.values()) == int(np.ceil(0.8 * 503))
    assert np.mean([got[i].kept for i in range(400)]) > 0.97
    assert np.mean([got[i].kept for i in range(400, 500)]) < 0.1
    ranked = sorted(got.values(), key=lambda x: -x.sample_key)
    assert all(x.kept for x in ranked[:403]) and not any(x.kept for x in ranked[403:])
    assert got[500].log_weight == got[501].log_weight == got[502].log_weight == 0
    assert quality.quality(table.limit(0), labels).count() == 0
    assert all(x.kept for x in quality.quality(table, labels.limit(0)).collect())
    clash = table.withColumn("quality", table.text).withColumn("key", table.doc_id)
    assert quality.quality(clash, labels, share=0.5).filter("kept").count() == 252


def test_radix_selection(spark):
    r = rng()
    values = [*r.integers(0, 2 ** 62, 300).tolist(), 0, 5, 5, 5, 2 ** 62]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 150, len(values) - 3, len(values)):
        assert quality.kth_greatest(df, k) == sorted(values, reverse=True)[k - 1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home</a>
<li>More</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class="c1">%s</div><article><header><h1>A &amp; B</h1>
</header><p>First   <b>bold</b>\n line.<br>Next<p>Second &lt;x&gt; 5 < 6</p><form>q</form><script>var a="</p>";</script>
<ul><li>one<li>two</ul></article><section id="comments"><p>Nice!</p></section><div>%s</div><footer>&copy; x</footer>"""


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_pages(spark, monkeypatch, most_sent):
    monkeypatch.setattr(site_tree, "MOST_SENT", most_sent)
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE % ("same on all pages", f"own {i}")) for i in range(40)]
    rows += [(100, None, None), (101, "http://h0.org/", ""), (102, "x", "plain &amp text"), (103, "http://h9.org", "<p>a<p"),
             (104, "http://h9.org/y", "<div>" * 3000 + "deep"), (105, "http://h9.org/z", PAGE % ("kept", "z")),
             (106, "http://h9.org/s", "<script>never ends <p>x</p>"), (107, "http://h9.org/t", "<p>a</p><!-- open <p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x for x in site_tree.extract(df).collect()}
    article = "A & B\nFirst bold line. Next\nSecond <x> 5 < 6\none\ntwo\n"
    for i in range(40):
        assert got[i].text == article + f"own {i}", got[i].text
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"http://h{i % 2}.org/{i}"
    expected = {100: "", 101: "", 102: "plain & text", 103: "a", 104: "deep", 105: "kept\n" + article + "z",
                106: "", 107: "a"}
    assert {i: got[i].text for i in expected} == expected
    assert site_tree.extract(df.limit(0)).count() == 0
    clash = df.withColumn("host", df.url).withColumn("text", df.url).withColumn("removed", df.url)
    assert site_tree.extract(clash).count() == len(rows)
    twice = site_tree.extract(df.union(df)).groupBy("page_id", "text").count().filter("count = 2").count()
    assert twice == len(rows)


def test_articles_and_own_blocks_stay_beside_repeated_ones(spark):
    top = "<div class='top'>Site name</div>"
    page = "<html><body>%s<article><p>Article %d</p></article>%s</body></html>"
    rows = [(i, f"http://a.org/{i}", page % (top, i, "")) for i in range(10)]
    rows += [(100 + i, f"http://b.org/{i}", page.replace("article", "main") % (top, i, "")) for i in range(10)]
    fixed = top + "<div class='x'>Same</div><div class='y'>Same too</div>"
    rows += [(200 + i, f"http://c.org/{i}", page % (fixed, i, f"<div class='own'>Own {i}</div>")) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in site_tree.extract(df).collect()}
    assert got == {**{i: f"Article {i}" for i in range(10)}, **{100 + i: f"Article {i}" for i in range(10)},
                   **{200 + i: f"Article {i}\nOwn {i}" for i in range(10)}}


def test_names_that_only_mention_asides_keep_their_text(spark):
    kept = ["<div class='with-sidebar'><article><p>T</p></article></div>", "<article class='post ad-free'>T</article>",
            "<main class='no-sidebar'>T</main>", "<article><p class='social-history'>T</p></article>"]
    gone = ["<div class='sidebar'>T</div>", "<div class='big site-header'>T</div>", "<div id='comment-list'>T</div>",
            "<section class='cookie_notice'>T</section>", "<div role='navigation'>T</div>", "<article class='comment'>T</article>"]
    df = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(kept + gone)],
                               "page_id long, url string, html string")
    got = {x.page_id: x.text for x in site_tree.extract(df).collect()}
    assert got == {i: "T" if i < len(kept) else "" for i in range(len(kept + gone))}


def slow_importance(pages):
    """Node -> importance on one host, by walking up from every block."""
    content, layout, parent = {}, {}, {}
    for page in pages:
        texts, layouts = site_tree.blocks(page)
        for node, up, _, children in layouts:
            parent[node] = up
            layout.setdefault(node, []).append(children)
        for node, aside, main, _, text in texts:
            if not (aside or main) and node != site_tree.ROOT:
                content.setdefault(node, []).append(text)
    nlogn = lambda items: sum(n * np.log(n) for n in Counter(items).values())
    below = {}
    for node, texts in content.items():
        at = node
        while at != site_tree.ROOT:
            n, total = below.get(at, (0, 0.0))
            below[at] = n + len(texts), total + nlogn(texts)
            at = parent[at]
    size, out = np.log(len(pages)), {}
    for node, (n, total) in below.items():
        styles = layout[node]
        weight = site_tree.GAMMA ** min(len(set(styles)), 50)
        spread = np.log(len(styles)) - nlogn(styles) / len(styles)
        out[node] = (1 - weight) * spread / size + weight * (1 - total / n / size)
    return out, parent


def test_importance_and_removed_nodes_match_brute_force(spark, tmp_path):
    r = rng()

    def branch(depth):
        inner = f"text {r.integers(0, 4)}" if r.random() < 0.5 else "same"
        for _ in range(int(r.integers(0, depth))):
            inner = f"<div class='k{r.integers(0, 3)}'>{inner}</div>" + ("x" if r.random() < 0.3 else "")
        return inner

    fixed = "<div class='fix'><div class='in'>Same</div><div class='in'>Same</div></div>"
    pages = [f"<body>{fixed}{''.join(f'<section>{branch(9)}</section>' for _ in range(int(r.integers(1, 5))))}</body>" for _ in range(30)]
    pages += ["<div>" * 40 + f"deep {i}" for i in range(3)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(4)
    scratch = Scratch(spark, "importance-test")
    scores, parents, deepest = site_tree.importance(site_tree.style_counts(df), scratch)
    want, parent = slow_importance(pages)
    got = {x.node: x.importance for x in scores.collect()}
    assert got == {n: pytest.approx(v, abs=1e-9) for n, v in want.items()}
    keep = set()
    for node, value in want.items():
        while value >= site_tree.THRESHOLD and node != site_tree.ROOT:
            keep.add(node)
            node = parent[node]
    low = set(want) - keep
    removed = site_tree.removable(scores, parents, deepest, scratch).collect()
    assert {n for x in removed for n in x.removed} == {n for n in low if parent[n] not in low} != set()


def test_deep_pages_take_time_in_proportion(spark):
    rows = [(i, "http://deep.org/", f"<div>a{i}" * (20_000 if i else 9000)) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(x.n_chars > 0 for x in site_tree.extract(df).collect())
