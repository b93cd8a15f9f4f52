"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from quaesitor.llm import toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.scores(docs, labels).filter("predicted = 1").collect()}
    kept = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2] and kept[-1], name
    assert kept[1] == kept[0] - rejected
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == kept[-1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[-1]
