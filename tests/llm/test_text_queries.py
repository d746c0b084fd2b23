"""The registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import difference, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from tollway.llm.oracle import llm_oracle  # noqa: E402
from tollway.llm.queries import llm_queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(spark, duck(sf_dir), name, sf_dir) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
    assert n > counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0.5 * n
    assert docs.where(F.col("rate") < 0).isEmpty()
    assert docs.where("n_chars <> length(text)").isEmpty()


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
