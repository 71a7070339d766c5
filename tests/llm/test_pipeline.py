"""The pipeline's stages, one after the other, each against what it was given."""

from collections import Counter

import pytest
from test_decontaminate import dc
from test_neardup import brute_classes

import corpus_pipeline
from marketlens.llm import packing, quality


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Each stage's output, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(tables):
    assert len(corpus_pipeline.STAGES) == 4
    for df in tables[1:-1]:
        assert df.columns == tables[0].columns
        assert df.count() == df.distinct().count()


def test_quality_stage(spark, sf_dir, tables):
    scored = quality.op9_quality(spark, sf_dir).where("kept").collect()
    assert rows_of(tables[1]).keys() == {r["doc_id"] for r in scored}


def test_near_duplicate_stage(tables):
    before = [(r["doc_id"], r["text"]) for r in tables[1].collect()]
    assert rows_of(tables[2]).keys() == set(brute_classes(before))


def test_decontamination_stage(spark, sf_dir, tables):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = rows_of(tables[3])
    for doc_id, row in rows_of(tables[2]).items():
        text = " " + " ".join(dc.words_of(row["text"])) + " "
        if any(" " + " ".join(dc.words_of(t)) + " " in text for t in items):
            assert doc_id not in left
    assert len(left) > 0.8 * tables[2].count()


def test_packing_stage(tables):
    lengths = Counter()
    for r in tables[4].collect():
        lengths[r["doc_id"]] += r["n_tokens"]
    assert lengths == {i: len(r["text"].encode().split()) + 1
                       for i, r in rows_of(tables[3]).items()}
    full = tables[4].groupBy("bin").sum("n_tokens").collect()
    assert max(r[1] for r in full) <= packing.CAPACITY


def test_empty_documents(spark, sf_dir, tables):
    docs = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
