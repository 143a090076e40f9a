"""The corpus pipeline, stage by stage, against what its operators say."""

import corpus_pipeline
from loomwork.llm.decontamination import contamination
from loomwork.llm.quality_rules import quality_rules
from loomwork.plans.storage import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(materialize(stage(spark, results[-1], SMALL), name))
    first, good, lines, single, clean, packed = results
    assert all(r.columns == columns for r in results[:-1])
    kept = {r.doc_id for r in quality_rules(first).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    assert {r.doc_id for r in lines.collect()} == kept
    assert lines.where("n_chars <> length(text)").count() == 0
    assert single.count() == single.select("doc_id").distinct().count() <= lines.count()
    assert contamination(clean, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
