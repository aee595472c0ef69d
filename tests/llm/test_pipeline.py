"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from lodestone.llm import queries
from lodestone.llm.common import Stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Stored(stage(spark, docs, SF), "test-stage").df
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(set(now)) == len(now) and set(now) <= before
        before = left[name] = set(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    judged = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, SF).collect()}
    assert left["quality rules"] == {k for k, v in judged.items() if v}
    assert len(left["mixing sources to target weights"] & toxic) <= len(left["benchmark decontamination"] & toxic)
    assert left["token-ID / binary output"] == left["mixing sources to target weights"]
