"""The pipeline's stages: columns, what goes and what stays, and pieces that rebuild the last texts."""

import numpy as np
import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name == "packing":
            break
        assert docs.columns == columns, name
        docs = docs.cache()
        seen.append(docs.count())
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.98
            assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.1
        if name == "line dedup":
            assert docs.select("n_chars").groupBy().sum().first()[0] < before.selectExpr("length(text) n").groupBy().sum().first()[0]
        if name == "PII":
            assert docs.where("text like '%@mail%'").count() == 0 and docs.where("text like '%[EMAIL]%'").count() > 0
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2] and seen[4] == seen[3]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.select("doc_id").collect()}
    k = min(r.doc_id for r in pieces)
    own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
    assert sum(r.length for r in own) == own[0].doc_tokens and own[-1].tokens[-1] == 2


def test_empty_table(spark, tmp_path):
    for n in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
