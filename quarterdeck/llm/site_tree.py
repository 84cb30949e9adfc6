"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is the path of block elements
(tag and class) that leads to it.  A node's content is important if its texts differ from
page to page (entropy of each text over the host's pages), its presentation if the sequence
of its child styles does.  Branches in which no node is important, and those whose tag or
class says that they are navigation, advertising and the like, are removed from every page;
what is left is the main text.  Text inside of article and main has no entropy and stays,
whatever the branches around it are like.

A node is a number, the hash of its parent's number and its own style.  The merged tree is counted
as (host, node, text hash) and (host, node, layout hash), combined map-side, so that a host with
a third of all pages costs no more than its distinct texts.  What lies below a node is added up
by doubling steps towards the root, as many as the logarithm of the depth.  Only a host's
topmost removable nodes travel back to its pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.scratch import Scratch
from quarterdeck.llm.url_filter import host_and_path

#: fixed values: elements by what HTML makes of them
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var br img wbr input".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer "
                             "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: elements and words of class, id or role that say "not the article"
ASIDE_TAGS = frozenset("nav footer aside form header button select menu dialog head".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
                        "cookie cookies footer header menu nav navbar navigation newsletter notice popup promo "
                        "related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: words that beside one of those change nothing: what a name of these words alone says is certain;
#: of other names (with-sidebar, ad-free, social-history) the entropies decide
NEUTRAL_WORDS = frozenset("area bar block body bottom box column container content cookies group inner item items left "
                          "links list main outer page panel post right row section site slot top unit wrap wrapper "
                          "reader user".split())
MAIN_TAGS = frozenset(("article", "main"))

#: below this importance a branch goes, on hosts with enough pages to tell
THRESHOLD = 0.3
LEAST_PAGES = 8
#: removable nodes of all hosts that are sent to every task, at most; parts of a host beyond that
MOST_SENT = 100_000
SALTS = 64
#: weight of the content below a node against its own presentation, per child style
GAMMA = 0.9
ROOT = 0

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|[^<]+|<""",
                   re.S)
MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS = re.compile(r"""class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


class Element:
    """An open element: its node, whether it or one around it is no article or removed, and its child styles."""

    __slots__ = ("tag", "node", "aside", "main", "gone", "children")

    def __init__(self, tag: str, node: int, aside: bool, main: bool, gone: bool):
        self.tag, self.node, self.aside, self.main, self.gone, self.children = tag, node, aside, main, gone, []


def node_of(parent: int, style: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}>{style}", 0) >> 1


def is_aside(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in ASIDE_TAGS and not (tag == "header" and inside_main):
        return True
    if tag in ("body", "html"):
        return False
    for marked in MARKED.finditer(attributes):
        for name in (marked[1] or marked[2] or marked[3] or "").lower().split():
            words = [w for w in re.split(r"[\W\d_]+", name) if w]
            if not ASIDE_WORDS.isdisjoint(words) and all(w in ASIDE_WORDS or w in NEUTRAL_WORDS for w in words):
                return True
    return False


def blocks(page: str, removed: frozenset[int] = frozenset()
           ) -> tuple[list[tuple[int, bool, bool, bool, str]], list[tuple[int, int, int, str]]]:
    """(node, aside, main, gone, text) of every non-empty block, and (node, parent, depth, child styles)
    of every element; ``gone`` are those in or below a removed node."""
    root = Element("", ROOT, False, False, False)
    stack, out, layouts, text, opened = [root], [], [], [], Counter()

    def flush():
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                top = stack[-1]
                out.append((top.node, top.aside, top.main, top.gone, joined))
            text.clear()

    def close(depth: int):
        flush()
        while len(stack) > depth:
            element = stack.pop()
            opened[element.tag] -= 1
            layouts.append((element.node, stack[-1].node, len(stack), " ".join(element.children)))

    at, end = 0, len(page)
    while at < end:
        piece = PIECE.match(page, at)
        at = piece.end()
        tag = piece[2]
        if tag is None:
            # comments, declarations and broken or unfinished tags are markup; a lone '<' is text
            if piece[0][0] != "<" or len(piece[0]) == 1:
                text.append(piece[0])
            continue
        tag = tag.lower()
        if piece[1]:
            if tag not in INLINE:
                if opened[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                else:
                    flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            flush()
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        if tag in CLOSES_PARAGRAPH and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1].tag == tag:
            close(len(stack) - 1)
        flush()
        named = CLASS.search(piece[3]) if piece[3] else None
        style = tag + ("." + ".".join((named[1] or named[2] or named[3] or "").split()) if named else "")
        top = stack[-1]
        top.children.append(style)
        if tag in VOID:
            continue
        main = top.main or tag in MAIN_TAGS
        node = node_of(top.node, style)
        opened[tag] += 1
        stack.append(Element(tag, node, top.aside or is_aside(tag, piece[3], top.main), main,
                             top.gone or node in removed))
    close(1)
    return out, layouts


def main_text(page: str, removed: frozenset[int]) -> str:
    """The blocks of ``page`` outside of known and of ``removed`` branches, one per line; those of
    article and main are left out by known branches alone."""
    return "\n".join(text for _, aside, main, gone, text in blocks(page, removed)[0] if not aside and (main or not gone))


def style_counts(pages: DataFrame) -> DataFrame:
    """host, node, parent, depth, kind ('content', 'layout' or 'pages'), feature (hash), n: how often, per host."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            tally: Counter[tuple[str, int, int, int, str, int]] = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts, layouts = blocks(page)
                tally[host, ROOT, ROOT, 0, "pages", 0] += 1
                for node, aside, main, _, text in texts:
                    if not (aside or main):
                        tally[host, node, ROOT, 0, "content", digest(text) >> 1] += 1
                for node, parent, depth, children in layouts:
                    tally[host, node, parent, depth, "layout", digest(children) >> 1] += 1
            columns = [*zip(*tally)] or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(tally.values()), pa.int64())],
                ["host", "node", "parent", "depth", "kind", "feature", "n"])

    keys = ["host", "node", "parent", "depth", "kind", "feature"]
    return pages.select("host", "html").mapInArrow(
        count, "host string, node long, parent long, depth long, kind string, feature long, n long").groupBy(*keys).agg(
        F.sum("n").alias("n"))


def with_below(nodes: DataFrame, parents: DataFrame, deepest: int, scratch: Scratch, name: str, combine) -> DataFrame:
    """host, node and the other columns of ``nodes``, each combined over the node and all nodes below it.

    ``parents(host, node, parent)`` has every node.  Each round hands what a node has gathered to the
    node twice as far above it as the round before.
    """
    values = [c for c in nodes.columns if c not in ("host", "node")]
    gathered, above, step = nodes, parents.filter(F.col("parent") != ROOT), 0
    while True:
        handed = gathered.join(above, ["host", "node"]).select("host", F.col("parent").alias("node"), *values)
        gathered = scratch.write(gathered.unionByName(handed).groupBy("host", "node").agg(
            *[combine(c).alias(c) for c in values]), f"{name}{step}")
        step += 1
        if 1 << step >= deepest:
            return gathered
        further = above.select("host", F.col("node").alias("parent"), F.col("parent").alias("further"))
        above = scratch.write(above.join(further, ["host", "parent"]).select(
            "host", "node", F.col("further").alias("parent")), f"{name}_above{step}")


def removable(scores: DataFrame, parents: DataFrame, deepest: int, scratch: Scratch) -> DataFrame:
    """host, removed: the topmost nodes that have a low importance and no important one below them."""
    important = scores.select("host", "node", (F.col("importance") >= THRESHOLD).cast("int").alias("kept"))
    unimportant = with_below(important, parents, deepest, scratch, "kept", F.max).filter("kept = 0").select("host", "node")
    low = unimportant.join(parents, ["host", "node"])
    above = unimportant.withColumnRenamed("node", "parent")
    return low.join(above, ["host", "parent"], "left_anti").groupBy("host").agg(F.collect_set("node").alias("removed"))


def importance(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """host, node, importance of every node that has content below it, on hosts with enough pages;
    host, node, parent of all their nodes; and the greatest depth."""
    nodes = counts.groupBy("host", "node", "kind").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("kinds"),
        F.max("parent").alias("parent"), F.max("depth").alias("depth"))
    sizes = nodes.filter(f"kind = 'pages' AND n >= {LEAST_PAGES}").select("host", F.log("n").alias("log_pages"))
    nodes = scratch.write(nodes.filter("kind <> 'pages'").join(sizes, "host"), "nodes")
    layout = nodes.filter("kind = 'layout'")
    parents = layout.select("host", "node", "parent")
    deepest = layout.agg(F.max("depth")).first()[0] or 1
    content = with_below(nodes.filter((F.col("kind") == "content") & (F.col("node") != ROOT)).select("host", "node", "n", "nlogn"),
                         parents, deepest, scratch, "content", F.sum)
    weight = F.pow(F.lit(GAMMA), F.least("kinds", F.lit(50)))
    spread = layout.select("host", "node", (F.log("n") - F.col("nlogn") / F.col("n")).alias("spread"), "kinds", "log_pages")
    return scratch.write(content.join(spread, ["host", "node"]).select(
        "host", "node", ((1 - weight) * F.col("spread") / F.col("log_pages")
                         + weight * (1 - F.col("nlogn") / F.col("n") / F.col("log_pages"))).alias("importance")),
        "importance"), parents, deepest


def with_removed(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Add each page's removable nodes.  A short list goes to every task, as its size says; a long
    one is joined, with each host's pages dealt over SALTS parts."""
    nodes = removed.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    if nodes <= MOST_SENT:
        return pages.join(F.broadcast(removed), "host", "left")
    salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    return pages.withColumn("salt", own).join(salted, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html counts as empty; a page without blocks has an empty text.  A null url, or one
    without host, belongs to the host ''.  Rows are extracted one by one, so repeated rows
    stay; they weigh more in their host's tree.  Hosts of fewer than LEAST_PAGES pages have no entropies:
    there names alone decide.  Other columns are ignored, an empty table gives an empty result, and a page
    is read by one task, in time that grows with its length.
    """
    host, _ = host_and_path(F.col("_url"))
    named = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                         F.col("url").cast("string").alias("_url")).withColumn("host", host).drop("_url")
    scratch = Scratch(pages.sparkSession, "sitetree")
    counts = scratch.write(style_counts(named), "counts")
    removed = scratch.write(removable(*importance(counts, scratch), scratch), "removed")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, frozenset(gone or ())) for page, gone in zip(
                batch.column("html").to_pylist(), batch.column("removed").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    return with_removed(named, removed).select("page_id", "url", "html", "removed").mapInArrow(
        texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
