"""Concatenate and cut against the tokenizer library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import byte_bpe as bb
from marketlens.llm import concat_cut as cc

PATH = bb.find_file(cc.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
TEXTS = [None, "", " ", "a  b\n\n c\t\n", "it's I'M  'll x y ​", "<|endoftext|> a",
         "a<|endoftext|>b ", "x\x1c y\x85z \x1f", "é ß 中文 🙂 ﻿", "tab\t\t end  ", "w " * 5000]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    bpe = bb.byte_bpe(cc.TOKENIZER)
    assert bpe.core is not None
    for text in [*TEXTS, " " * 200_000 + "x", "\n" * 9000, "ab" * 100_000]:
        assert bpe.encode(text).tolist() == library(text)
        assert bpe.encode_plain(text or "").tolist() == PLAIN.encode(
            text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.,'sdt1aX<|>"), st.characters()),
               max_size=40))
def test_encoder_any_text(text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert bb.byte_bpe(cc.TOKENIZER).encode(text).tolist() == library(text)


def test_other_file_goes_to_library():
    path = bb.find_file("word_bpe_49k.json")
    bpe = bb.ByteBPE(path)
    assert bpe.core is None
    assert bpe.encode("Some Words.").tolist() == Tokenizer.from_file(path).encode(
        "Some Words.", add_special_tokens=False).ids


def check(rows, docs, capacity, end_id):
    """All pieces tile all documents and all sequences."""
    expected = sorted((i is not None, i or 0, tuple(library(t) + [end_id])) for i, t in docs)
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    line = 0
    for r in by_place:
        assert r["sequence_id"] * capacity + r["offset"] == line
        assert r["offset"] + r["length"] <= capacity and r["length"] > 0
        line += r["length"]
    found, ids = [], []
    for r in by_place:
        if r["start"] == 0:
            found.append([r["doc_id"], r["doc_tokens"], []])
        assert found[-1][0] == r["doc_id"]
        assert sum(n for n, _ in found[-1][2]) == r["start"]
        found[-1][2].append((r["length"], r["ids_crc32"]))
    for doc_id, n, parts in found:
        assert sum(k for k, _ in parts) == n
    # Checksums of the pieces against those of some document of that id.
    left = list(expected)
    for doc_id, n, parts in found:
        for k, (named, i, whole) in enumerate(left):
            at, same = 0, (named, i, len(whole)) == (doc_id is not None, doc_id or 0, n)
            for length, crc in parts if same else ():
                same &= zlib.crc32(np.array(whole[at:at + length], "<u4").tobytes()) == crc
                at += length
            if same:
                ids += left.pop(k)[2]
                break
        else:
            raise AssertionError(doc_id)
    assert not left
    return ids


@pytest.mark.parametrize("capacity", [5, 64, 2048])
def test_pieces_and_sequences(spark, tmp_path, capacity):
    docs = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS * 4)] + [(5, "tie"), (5, "tie")]
    random.Random(capacity).shuffle(docs)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs],
                               "doc_id long, text string, part string, position int")
    path = str(tmp_path / "ids")
    cc.write_ids(df.repartition(5), path, end_id=7)
    line = cc.positions(spark, path)
    ids = check(cc.pieces(line, capacity).collect(), docs, capacity, 7)
    out = sorted(cc.sequences(line, capacity, pad_id=9).collect())
    assert [r[0] for r in out] == list(range(-(-len(ids) // capacity)))
    joined = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in out]).tolist()
    assert joined[:len(ids)] == ids and set(joined[len(ids):]) <= {9}
    last = out[-1]["n_tokens"]
    assert sum(r["n_tokens"] for r in out) == len(ids)
    assert len(out[-1]["ids"]) == 4 * (last if last & (last - 1) == 0 else capacity)


def test_very_long_text_and_empty(spark, tmp_path):
    long = "word " * 400_000 + " " * 100_000
    df = spark.createDataFrame([(1, long), (2, "b")], "doc_id long, text string")
    cc.write_ids(df, str(tmp_path / "long"))
    rows = cc.pieces(cc.positions(spark, str(tmp_path / "long"))).collect()
    check(rows, [(1, long), (2, "b")], 2048, cc.END_ID)
    cc.write_ids(df.where("false"), str(tmp_path / "none"))
    line = cc.positions(spark, str(tmp_path / "none"))
    assert cc.pieces(line).collect() == [] and cc.sequences(line).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    check(cc.op12_concat_packing(spark, sf_dir).collect(), docs, cc.CAPACITY, cc.END_ID)
