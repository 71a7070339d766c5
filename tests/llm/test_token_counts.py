"""Transducer counts against the tokenizer library."""

import random
import resource

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import token_counts

PATH = public_tokenizers.path(token_counts.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = token_counts.transducer(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


TEXTS = [
    "", " \n", "Don't they'll I'M 's 'S ''s a's'd it's1st", "ΟΔΟΣ ΣΑΣ σας", "İstanbul ǅ ﬁ",
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> <|ENDOFTEXT|>", "</w> a</w>",
    "été ẛ̣ a b c\x1cd\x85e​f", "１２３ ½ ² 中文字 한국어 ไทย",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "!!!???...", "🙂🙃 👩‍👩‍👧", "x" * 5000 + " y",
    "%%% ea *** nd### \t\x0b\x0c\r", "﻿abc\u0000d",
]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_texts(chunk):
    for text in TEXTS:
        assert MACHINE.count(text, chunk) == expected(text), text[:60]


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from("aehinorst 'dmlvS.,\n1"),
                                  st.characters(max_codepoint=0x24F)), max_size=60))
def test_any_latin_text(text):
    assert MACHINE.count(text, 5) == expected(text)


def test_random_letters():
    rng = random.Random(3)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "thand", "éèüößa"):
        for _ in range(600):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24)))
            assert MACHINE.count(word) == expected(word), word


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_WORDS", 3)
    monkeypatch.setattr(token_counts, "MAX_STEPS", 5)
    machine = token_counts.CountTransducer(PATH)
    for text in TEXTS[:12]:
        assert machine.count(text, 50) == expected(text)


def test_scan_gives_every_prefix():
    text = "the quick brownfox jumps " * 9
    maps = [MACHINE.chunk_map(text[i:i + 10]) for i in range(0, len(text), 10)]
    for i, m in enumerate(MACHINE.scan(maps)):
        assert MACHINE.total(m) == expected(text[:10 * (i + 1)])


def test_very_long_text_without_white_space():
    """16 million characters; memory stays near a few copies of the text."""
    text = "ab1!" * 4_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert MACHINE.count(text) == 4_000_000 * expected("ab1!" * 50) // 50
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
    assert grown < 1500, grown


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "a b", 5), (2, "a b", 5)],
                               "doc_id long, text string, n_tokens int")
    rows = token_counts.count_tokens(df, limit=1).collect()
    assert sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"])
                   for r in rows)) == [(0, 0, 0, False), (1, 0, 0, False), (2, 3, 2, True),
                                       (2, 3, 2, True)]
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in token_counts.op6_token_counts(spark, sf_dir).collect():
        text = docs.pop(r["doc_id"])
        assert tuple(r)[1:] == (len(text.encode()), expected(text), expected(text) > 2048)
    assert not docs
