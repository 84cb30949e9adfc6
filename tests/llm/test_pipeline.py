import re

import corpus_pipeline
from quarterdeck.llm import decontaminate, toxicity
from tests.llm.helpers import docs, invented, rng
from tests.llm.test_first_operators import near_copies
from tests.llm.test_near_copies import slow_classes
from tests.llm.test_toxicity import BAD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    r = rng()
    item = invented(r, 30, 500)
    base = invented(r, 200, 500)
    texts, labels = [None, "", " ", item, f"{invented(r, 50, 500)} {item} end", "<|endoftext|> x"], []
    texts += [base] * 5 + near_copies(r, base, 10)
    for i in range(len(texts), 700):
        words = invented(r, int(r.integers(20, 200)), 500).split()
        if i % 5 == 0:
            for _ in range(max(2, len(words) // 20)):
                words[r.integers(len(words))] = BAD[r.integers(len(BAD))]
        labels.append((i, 1, int(i % 5 == 0)))
        texts.append(" ".join(words))
    texts += texts[20:60]
    table = docs(spark, texts)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return table, item


def test_pipeline_matches_brute_force(spark, tmp_path):
    table, item = corpus(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(documents, labels).collect() if r.predicted}
    assert 100 < len(toxic) < 170
    left = {r.doc_id: r.text or "" for r in table.collect() if r.doc_id not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in sorted(first.values())}
    classes = slow_classes(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    matcher = decontaminate.Matcher({0: item})
    left = {i: t for i, t in left.items() if not matcher.find(t)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(left)
    for r in got:
        assert r.length == len(r.ids) and r.doc_tokens >= r.start + r.length
    assert len({r.sequence_id for r in got}) == len(got)


def test_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path):
    corpus(spark, str(tmp_path))
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = documents.withColumns({c: documents.doc_id for c in ("parent", "head", "n", "done", "row_id", "fingerprint")})
    for source in (documents.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, str(tmp_path))
            assert out.columns == source.columns, name
            assert (out.count() > 0) == (source is odd)
