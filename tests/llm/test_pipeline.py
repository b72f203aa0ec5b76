"""The pipeline against a plain version of its stages, and its registration."""

import re

import corpus_pipeline
from test_near_duplicates import plain_groups

import __spark_entry__
from atlasweave.llm import packing, pii, quality, toxicity


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < 0.5}
    good = {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    left = [(i, text[i].text) for i in sorted(clean & good)]
    one = {min(left[k][0] for k in own) for own in plain_groups(left)}  # near copies by 5-word shingles, by brute force
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        seen = corpus_pipeline.materialise(stage(spark, seen, sf), name)
        ids = {r.doc_id for r in seen.collect()}
        if name != "packing":
            assert seen.columns == columns
        assert ids == {"toxicity": clean, "quality": clean & good}.get(name, one)
        if name == "pii":
            for r in seen.collect():
                spans = pii.all_spans([text[r.doc_id].text], pii.model())[0][1]
                assert r.text == pii.redacted(text[r.doc_id].text, spans) and r.n_chars == len(r.text)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, seen.select("doc_id", "start", "length", "ids_crc32").collect()))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not any(labels[i].quality == 0 and text[i].text and i in one for i in labels)
    assert packing.MAX == 2048


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert not {n for n in __spark_entry__.oracle_sql() if re.match(r"op\d+_", n)}
