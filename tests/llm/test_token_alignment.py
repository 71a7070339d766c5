"""Alignment of two tokenizers against a plain walk over every document."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlens.llm import token_alignment as ta
from marketlens.llm.byte_bpe import byte_values, find_file

PATH_A, PATH_B = find_file(ta.TOKENIZER_A), find_file(ta.MODEL_B)
A = Tokenizer.from_file(PATH_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
VALUES = byte_values()
ENTRIES = {i: bytes(VALUES[c] for c in t) for t, i in json.load(
    open(PATH_A, encoding="utf-8"))["model"]["vocab"].items() if all(c in VALUES for c in t)}
TEXTS = [None, "", " ", "a", "two words", "a  b", " leading", "trailing ", "line\nbreak",
         "<|endoftext|> a</s>", "▁ under", "é ß 中文 🙂 and text", "internationalisation",
         "======== ==== =", "x" * 300, "the same text here", "the same text here",
         "tokenization of unusual words, e.g. Zyxwvut 12345.678!", "ﬁ ligature", "a\tb", "<unk>"]


def bytes_of_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def walk(text):
    """Groups ([A ids], [B ids]) of a text."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(ENTRIES[i] for i in a) != raw or b"".join(map(bytes_of_b, b)) != raw:
        return []
    size_a, size_b = (lambda i: len(ENTRIES[i])), (lambda i: len(bytes_of_b(i)))
    groups, open_a, open_b, end_a, end_b, j = [], [], [], 0, 0, 0
    for i in a:
        open_a.append(i)
        end_a += size_a(i)
        while j < len(b) and end_b + size_b(b[j]) <= end_a:
            open_b.append(b[j])
            end_b += size_b(b[j])
            j += 1
        if end_a == end_b:
            groups.append((open_a, open_b))
            open_a, open_b = [], []
    return groups


def brute(docs):
    every = [(i, walk(t)) for i, t in docs]
    count = Counter()
    for _, groups in every:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in every:
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups),
                    len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                    sum(count[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


@pytest.mark.parametrize("block_chars,lane", [(1, 2), (300, 3), (ta.BLOCK_CHARS, ta.LANE)])
def test_brute_force(spark, block_chars, lane):
    docs = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * 2)] + [(5, "tie"), (5, "tie")]
    random.Random(lane).shuffle(docs)
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs],
                               "doc_id long, text string, block string, places double")
    got = ta.alignment(df.repartition(3), block_chars=block_chars, lane=lane)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs), key=key)


def test_groups(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for r in ta.groups(df).collect():
        expected, a, b = walk(TEXTS[r["doc_id"]]), 0, 0
        assert len(expected) == len(r["ends_a"]) == len(r["ends_b"])
        for (ids_a, ids_b), end_a, end_b in zip(expected, r["ends_a"], r["ends_b"]):
            assert r["ids_a"][a:end_a] == ids_a and r["ids_b"][b:end_b] == ids_b
            a, b = end_a, end_b


def test_very_long_text(spark):
    text = ("some Unusual wordforms here, 123 " * 300).strip()
    df = spark.createDataFrame([(1, text), (2, "some words")], "doc_id long, text string")
    assert sorted(map(tuple, ta.alignment(df).collect())) == brute([(1, text), (2, "some words")])
    # A million words, known by their parts: every group of the short text comes so often.
    text = "some words " * 500_000 + "some words"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = ta.alignment(df).first()
    short = walk("some words")
    assert row["n_groups"] == 500_001 * len(short)
    assert row["n_a"] == 500_001 * sum(len(a) for a, _ in short)
    assert row["count_sum"] == row["n_links"] == 500_001 * sum(len(a) * len(b) for a, b in short)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment(df).collect() == []
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, ta.alignment(df).collect()), key=key) == sorted(
        brute([(1, None), (None, "")]), key=key)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = sorted(map(tuple, ta.op13_token_alignment(spark, sf_dir).collect()))
    assert got == sorted(brute(docs))
