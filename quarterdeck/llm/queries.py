"""The operators as registered queries over the given tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import collocations, conversation_repair, decontaminate, exact_dedup, lm_scoring, packing, quality
from quarterdeck.llm import sharding, simhash_dedup, site_tree, suffix_dedup, toxicity, url_filter

RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
         url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
         url_filter.Rule("block", "net", "/fr/")]

SHARD_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"), damage=True).report()


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_toxicity, op4_simhash, op5_decontaminate,
                            op6_quality, op7_site_tree, op8_suffix_dedup, op9_sharding, op10_packing, op11_conversation_repair,
                            op12_lm_scoring, op13_collocations, pipeline)}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n""",
    "op2_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a
           FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(a, ''), '^[^/?#]*'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, rh || rp AS rule, verdict FROM s JOIN r
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM m GROUP BY page_id)
SELECT s.page_id, host, path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM s LEFT JOIN b ON s.page_id = b.page_id""",
    "op13_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09]+') AS w FROM t),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS size),
starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE len(w) >= size),
f AS (SELECT lang, size, list_slice(w, i, i + size - 1) AS p, count(*)::HUGEINT AS a FROM starts GROUP BY ALL
      HAVING count(*) >= 100),
cuts AS (SELECT lang, p, a, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (SELECT c.lang, c.p, c.a, c.size, c.k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.k)
           JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.k + 1, c.size) JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, a, p, size, unnest(range(2, size)) AS part FROM f WHERE size > 2),
parts AS (SELECT lang, a, list_slice(p, i, i + part - 1) AS p FROM (
          SELECT *, unnest(range(1, size - part + 2)) AS i FROM inside)),
longer AS (SELECT lang, p, max(a) AS a FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer ON longer.lang = b.lang AND longer.p = b.p
         WHERE NOT coalesce(100 * longer.a >= 100 * b.a, false)),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (
           PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked WHERE rank <= 2000""",
}
