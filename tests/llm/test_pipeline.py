import os

import pytest

import corpus_pipeline
from emberflow.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert sorted(out.columns) == sorted(columns), name
            assert out.count() > 0.5 * n
        if name == "jaccard_join":
            assert out.select("doc_id").distinct().count() == out.count()
        docs = out
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)


def test_empty_documents(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
