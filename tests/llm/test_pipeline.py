"""The pipeline's stages: each works on what its predecessor kept."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path, small):
    base = spark.read.parquet(f"{small}/documents.parquet").limit(150)
    rng = [f"word{k * 7919 % 1000}" for k in range(400)]
    planted = [(10_000, " ".join(rng), "en", "p", 1), (10_001, " ".join(rng), "en", "p", 1), (10_002, " ".join(rng[:200] + ["new"] + rng[201:]), "en", "p", 1), (10_003, "a clean text of its own " + " ".join(rng[100:170]), "en", "p", 1), (None, "no id at all", "en", "p", 1), (10_004, None, None, None, None)]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema)).withColumn("kept", F.lit(1))
    near = corpus_pipeline.stage_near_dedup(spark, docs, small)
    assert near.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in near.collect()}
    assert 10_000 in ids and 10_003 in ids and None in ids and 10_004 in ids and not ids & {10_001, 10_002}
    cut = corpus_pipeline.stage_suffix_dedup(spark, near, small)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == ids and texts[10_003].startswith("a clean text of its own") and len(texts[10_003]) < 60
    packed = corpus_pipeline.stage_packing(spark, cut, small)
    assert {r.doc_id for r in packed.collect()} == ids


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 100 and len(corpus_pipeline.STAGES) == 4
    empty = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, tiny)
        assert empty.count() == 0


def test_suffix_stage_tells_rows_of_one_id_apart(spark):
    passage = " ".join(f"passage{k}" for k in range(20))
    rows = [(1, passage), (5, "first text of five " + passage), (5, "second text of five, all clean"), (6, "one of six " + passage), (6, "two of six, longer, " + passage), (6, "one of six " + passage), (None, "no id " + passage), (None, "no id, clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(((r.doc_id or 0), r.text, r.n_chars) for r in corpus_pipeline.stage_suffix_dedup(spark, docs, "").collect())
    want = [(1, passage), (5, "first text of five"), (5, "second text of five, all clean"), (6, "one of six"), (6, "two of six, longer,"), (6, "one of six"), (0, "no id"), (0, "no id, clean")]
    assert [(i, t.strip()) for i, t, _ in got] == sorted((i, t) for i, t in want)
    assert all(n == len(t) for _, t, n in got)
