"""The pipeline on the smallest tables, stage by stage, against brute force."""

import os

import pytest

import corpus_pipeline
from terrane.llm import line_dedup, quality

from . import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_run(spark):
    docs, labels, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    keep = {r["doc_id"] for r in quality.score_documents(docs, labels).where("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in keep]
    assert len(rows) > 100
    texts = brute.maximal_line_dedup(rows, line_dedup.MIN_CHARS)
    rows = [(i, t) for (i, was), t in zip(rows, texts) if t == was or t]
    rows = [r for r, n in zip(rows, brute.near(rows, corpus_pipeline.SIMILAR)) if n[3]]
    questions = [(r["item_id"], r["text"]) for r in items.collect()]
    rows = [r for r, c, whole in zip(rows, brute.contamination(rows, questions), brute.whole_windows(rows, questions)) if not (c[-1] or whole)]
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == sorted((i, brute.sha(t)) for i, t in rows)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
