"""The pipeline's stages keep the documents' columns and do what their operators decide."""

import corpus_pipeline
from evalspark.llm.jaccard import near_duplicates
from evalspark.plans.scratch import table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
        kept.append(docs.count())
        if name == "near_duplicates":
            groups = {r.component_id for r in near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == groups
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == kept[-1]


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
