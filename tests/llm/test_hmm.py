"""Likelihoods against sums over all state paths, base scores against plain counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from marketlens.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def tiny_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)

    def rows(*shape):
        x = rng.uniform(0.1, 1, shape)
        return x / x.sum(-1, keepdims=True)

    return hmm.Model(rows(states), rows(states, states), rows(states, classes))


def paths(model, seq):
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for i in range(1, len(seq)):
            p *= model.move[path[i - 1], path[i]] * model.emit[path[i], seq[i]]
        yield path, p


def test_forward_and_counts_against_all_paths():
    model = tiny_model()
    seqs = [[0, 1, 4], [2], [3, 3, 1, 0, 2], [1, 4]]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    found = hmm.log_likelihoods(model, flat, lengths)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq, ll in zip(seqs, found):
        every = list(paths(model, seq))
        total = sum(p for _, p in every)
        assert abs(math.log(total) - ll) < 1e-12
        for path, p in every:
            start[path[0]] += p / total
            for i, s in enumerate(path):
                emit[s, seq[i]] += p / total
                if i:
                    move[path[i - 1], s] += p / total
    counts = hmm.expected_counts(model, flat, lengths)
    assert np.allclose(counts, np.concatenate([start, move.ravel(), emit.ravel()]))


def test_long_sequences_do_not_underflow():
    ll = hmm.log_likelihoods(tiny_model(), np.tile([0, 1, 2, 3, 4], 10_000), np.array([50_000]))
    assert np.isfinite(ll).all() and ll[0] < -10_000
    none = np.array([], np.int64)
    assert len(hmm.log_likelihoods(tiny_model(), none, none)) == 0
    assert not hmm.expected_counts(tiny_model(), none, none).any()


def corpus(n, seed):
    """Texts of two kinds with words of their own: what a state can learn."""
    rng = random.Random(seed)
    kinds = [["a%d" % i for i in range(60)], ["b%d" % i for i in range(60)]]
    return [(i, " ".join(rng.choices(kinds[i % 2], k=rng.randint(5, 60))), i % 5 == 1)
            for i in range(n)]


def test_rounds_raise_the_likelihood(spark):
    docs = spark.createDataFrame(corpus(200, 1), "doc_id long, text string, held_out boolean")
    scores = []
    for rounds in (0, 1, 3, 8):
        rows = hmm.score_corpus(docs, states=2, rounds=rounds).collect()
        scores.append(sum(r["score"] for r in rows if not r["held_out"]))
    assert scores == sorted(scores)
    rows = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 50


def brute_base(rows):
    counts = Counter(t for _, text, held in rows if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text, held in rows:
        own = tokens(text)
        yield (doc_id, held, len(own), sum(counts[t] > 0 for t in own), n,
               sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))


def same(found, rows):
    def key(x):
        return str(x[:5])

    found = sorted((tuple(r) for r in found), key=key)
    for got, want in zip(found, sorted(brute_base(rows), key=key), strict=True):
        assert got[:5] == want[:5]
        assert abs(got[5] - want[5]) < 1e-6 * max(1, abs(want[5]))
        assert math.isfinite(got[6]) and got[6] < 0.001


def test_edges_and_blocks(spark):
    rows = [*corpus(40, 2), (7, None, False), (None, "", False), (None, " \n", True),
            (3, "A É b\x1cc\x0bd", False), (3, "A É b\x1cc\x0bd", False), (8, "z " * 4000, True)]
    docs = spark.createDataFrame([(*r, "x") for r in rows],
                                 "doc_id long, text string, held_out boolean, block string")
    for size in (1, 500, 1 << 24):
        same(hmm.score_corpus(docs, states=2, classes=16, rounds=1, block_bytes=size).collect(),
             rows)
    held = docs.selectExpr("doc_id", "text", "true AS held_out")
    out = hmm.score_corpus(held, rounds=1).collect()
    assert len(out) == len(rows) and {r["train_tokens"] for r in out} == {0}
    assert hmm.score_corpus(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t in docs]
    found = hmm.op2_lm_scores(spark, sf_dir).collect()
    same(found, rows)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
