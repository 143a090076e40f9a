"""Awkward rows: nulls, repeated rows, ties, megabyte texts, clashing names and empty tables, for operators and pipeline stages."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm.decontamination import contamination
from loomwork.llm.jaccard_join import jaccard_components
from loomwork.llm.licenses import license_scan
from loomwork.llm.line_dedup import dedup_lines
from loomwork.llm.quality_rules import quality_rules
from loomwork.llm.repeats import remove_repeats
from loomwork.llm.secrets import secret_spans
from loomwork.llm.toxicity import toxicity
from loomwork.plans.storage import materialize

SMALL = "/root/testdata/sf0.001"
#: Extra columns named like results.
EXTRA = "score double, spans string, kept string, family string, item_id long, similarity double, n_lines long, component_id string, held_out string, verdict string, piece string"
LONG = "word other third " * 70_000  # more than a megabyte
ITEM = " ".join(f"item{k}" for k in range(40))
ROWS = [
    (1, None, None), (2, "", "a"), (None, None, None), (3, "tie here and there now", "a"), (3, "tie here and there now", "a"), (4, "tie here and there now", "b"),
    (5, LONG, "b"), (6, LONG + "word", "b"), (7, ITEM + " and more", None), (8, ITEM, "c"), (9, "All rights reserved.\npassword = abcdefgh1", "c"), (9, "All rights reserved.\npassword = abcdefgh1", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [None] * len(EXTRA.split(", "))
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *extra) for i, t, s in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_every_row_has_its_result(spark, docs):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    ids = collections.Counter((i,) for i, *_ in ROWS)
    by = {f.__name__: f(docs).collect() for f in (secret_spans, dedup_lines, quality_rules, jaccard_components, remove_repeats)}
    by["toxicity"] = toxicity(docs, labels).collect()
    for name, got in by.items():
        assert collections.Counter((r.doc_id,) for r in got) == ids, name
    assert sorted(r.n_assign for r in by["secret_spans"] if r.doc_id == 9) == [1, 1]
    assert sorted((r.doc_id, r.component_id) for r in by["jaccard_components"] if r.doc_id in (3, 4, 5, 6)) == [(3, 3), (3, 3), (4, 3), (5, 5), (6, 5)]
    repeats = {r.doc_id: r for r in by["remove_repeats"]}
    assert repeats[5].n_removed == repeats[5].n_bytes and repeats[6].n_removed >= repeats[6].n_bytes - 1 and repeats[3].n_removed == 0
    lines = {r.doc_id: r for r in by["dedup_lines"]}
    assert lines[1].text is None and lines[2].text == "" and lines[5].text == LONG


def test_searches_report_repeated_rows_and_ties(spark, docs):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, ITEM, "x"), (3, None, "x"), (None, "", "x")], "item_id long, text string, doc_id string")
    got = contamination(docs, items)
    assert counted(got, "doc_id", "item_id") == {(7, 1): 1, (7, 2): 1, (8, 1): 1, (8, 2): 1}
    assert counted(license_scan(docs).where("confirmed"), "doc_id", "family") == {(9, "proprietary"): 2}
    assert license_scan(docs.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_stand_no_rows(spark, docs):
    own = docs.select(*spark.read.parquet(f"{SMALL}/documents.parquet").columns, "score", "verdict")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = materialize(stage(spark, own, SMALL), name)
        assert name == "packing" or found[name].columns == own.columns, name
        assert stage(spark, own.limit(0), SMALL).count() == 0
    assert counted(found["line_dedup"], "doc_id") == counted(own, "doc_id")
    single = found["jaccard_join"]
    assert counted(single.where(F.col("doc_id").isin(3, 4, 5, 6)), "doc_id") == {(3,): 1, (5,): 1} and single.where("text is null").count() == 2
