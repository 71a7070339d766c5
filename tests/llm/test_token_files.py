"""Round trip of token files against the tokenizer library."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import token_files as tf

PATH = public_tokenizers.path(tf.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "a  b\n\n c\t\n", "it's I'M  'll x y ​", "<|endoftext|> a",
         "a<|endoftext|>b ", "x\x1c y\x85z \x1f", "é ß 中文 🙂 ﻿", "tab\t\t end  ", "w " * 5000]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizer_file(spark, tmp_path):
    """A file with other rules than byte-level BPE's gives the library's ids, too."""
    name = "word_bpe_49k.json"
    other = Tokenizer.from_file(public_tokenizers.path(name))
    docs = spark.createDataFrame([(1, "Some Words, here.")], "doc_id long, text string")
    tf.write_tokens(docs, str(tmp_path / "other"), tokenizer=name, end_id=7)
    row = tf.read_tokens(spark, str(tmp_path / "other")).first()
    assert row["ids"] == other.encode("Some Words, here.", add_special_tokens=False).ids + [7]


def test_selective_reads(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"),
                                    F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = str(tmp_path / "some")
    tf.write_tokens(docs, path, parts=4)
    lengths = tf.read_lengths(spark, path)
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    assert lengths.count() == 2000
    some = tf.read_some(spark, path, 1000, 1009)
    plan = some._jdf.queryExecution().executedPlan().toString()
    # The one exchange is that of the parts' totals.
    assert "GreaterThanOrEqual(doc_id,1000)" in plan and plan.count("Exchange hash") == 1
    whole = {r["doc_id"]: r for r in tf.read_tokens(spark, path).collect()}
    assert sorted(some.collect()) == sorted(whole[i] for i in range(1000, 1010))


@pytest.mark.parametrize("delta", [False, True])
def test_round_trip(spark, tmp_path, delta):
    rows = [(i if i % 9 else None, t, "n") for i, t in enumerate(TEXTS * 3)] + [(5, "tie", "n")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs, path, end_id=7, parts=4, delta=delta)
    out = sorted(tf.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in out:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 7
        start += r["n_tokens"]
    expected = sorted((i is not None, i or 0, library(t) + [7]) for i, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in out) == expected
    chunk = pq.ParquetFile(max(glob.glob(f"{path}/*.parquet"))).metadata.row_group(0)
    ids_chunk = next(chunk.column(i) for i in range(chunk.num_columns)
                     if chunk.column(i).path_in_schema.startswith("ids"))
    wanted = "DELTA_BINARY_PACKED" if delta else "DICTIONARY"
    assert any(wanted in e for e in ids_chunk.encodings)
    assert ids_chunk.has_offset_index


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs, path)
    assert tf.ids_crc32(tf.read_tokens(spark, path)).collect() == []


def test_query(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
                  .select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in tf.op5_token_files(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in docs:
        ids = library(text) + [0]
        assert tuple(rows.pop(doc_id)) == (doc_id, start, len(ids),
                                           zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows
