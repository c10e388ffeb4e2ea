"""The pipeline's stages on a real table, each beside what its operator says of its own input."""

import collections

import corpus_pipeline
from dqspark.llm.mixing import mix
from dqspark.llm.quality import quality_rules
from dqspark.llm.simhash import simhash_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.cache()
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
    inputs["end"] = docs.cache()
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in inputs.items()}
    kept = [r.id for r in quality_rules(inputs["quality rules"]).where("kept").selectExpr("row.doc_id AS id").collect()]
    assert sorted(ids["line dedup"]) == sorted(kept)
    assert sorted(ids["near-duplicates"]) == sorted(kept)
    groups = simhash_components(inputs["near-duplicates"]).collect()
    assert sorted(ids["mixing"]) == sorted({r.component_id for r in groups})
    taken = {r.doc_id: r.taken for r in mix(inputs["mixing"]).collect() if r.taken}
    words = collections.Counter()
    for r in inputs["packing"].collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == taken
    assert set(ids["end"]) == set(ids["packing"])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
