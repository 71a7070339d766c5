"""Spaced seeds against an exhaustive comparison on every diagonal."""

import random
import re
import time

import numpy as np
import pytest

from marketlens.llm import decontaminate as dc

RNG = random.Random(5)
VOCABULARY = ["w%d" % i for i in range(400)]
ITEMS = [(i, " ".join(RNG.choices(VOCABULARY, k=RNG.randint(14, 50)))) for i in range(12)]


def sentence(n, seed):
    return random.Random(seed).choices(VOCABULARY, k=n)


def brute(text, items):
    """Items with a good enough stretch on any diagonal."""
    w, found = re.findall(r"[^\W_]+", (text or "").lower()), set()
    for item, t in items:
        own = re.findall(r"[^\W_]+", (t or "").lower())
        for shift in range(-len(own), len(w)):
            at = [i for i in range(len(own)) if 0 <= i + shift < len(w)]
            equal = [own[i] == w[i + shift] for i in at]
            best = (0, 0, 0)
            for a in range(len(at)):
                score = 0
                for b in range(a, len(at)):
                    score += 1 if equal[b] else -2
                    best = max(best, (score, a, b + 1))
            n = sum(equal[best[1]:best[2]])
            if len(own) >= 7 and n >= min(12, len(own)) and n >= 0.8 * (best[2] - best[1]):
                found.add(item)
    return found


def texts():
    out = [None, "", "short", " ".join(sentence(300, 1))]
    for k, (_, item) in enumerate(ITEMS):
        words = item.split()
        for i in range(4, len(words), [6, 7, 9, 50][k % 4]):
            words[i] = "changed"
        out.append(" ".join(sentence(40, k)) + " " + ", ".join(words).upper() + "\n"
                   + " ".join(sentence(20, 99 + k)))
    half = ITEMS[0][1].split()[:13]
    return [*out, " ".join(half), " ".join(half[:9] + sentence(9, 4)), "same " * 3000]


def found_items(spark, rows, items, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, overlaps string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return dc.find_overlaps(docs, bench, **options).collect()


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_against_brute_force(spark, block_bytes):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    out = found_items(spark, rows, ITEMS, block_bytes=block_bytes)
    assert len(out) == len(rows)
    for r in out:
        assert {o["item_id"] for o in r["overlaps"]} == brute(rows[r["doc_id"]][1], ITEMS)
    assert sum(bool(r["overlaps"]) for r in out) >= 12


def test_best_stretch():
    equal = np.array([1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 1, 1], bool)
    assert dc.best_stretch(equal) == (5, 12)
    assert dc.best_stretch(np.zeros(3, bool)) == (0, 0)


def brute_stretch(equal):
    """Most equal words in any stretch with a share of at least 0.8."""
    n = len(equal)
    return max((sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1)
                if 5 * sum(equal[a:b]) >= 4 * (b - a)), default=0)


def test_best_of_all_stretches():
    rng = random.Random(8)
    for k in range(400):
        equal = [rng.random() < (0.95, 0.8, 0.7, 0.5)[k % 4] for _ in range(rng.randint(1, 45))]
        a, b = dc.best_stretch(np.array(equal, bool))
        assert sum(equal[a:b]) == brute_stretch(equal)
        assert 5 * sum(equal[a:b]) >= 4 * (b - a)
        assert a == b or equal[a] and equal[b - 1]


def test_more_overlap_is_not_less():
    item = ["i%d" % i for i in range(44)]
    block = dc.Block.of([(7, " ".join(item))])
    copied = list(item)
    for i in (*range(12, 17), *range(28, 33)):
        copied[i] = "changed"
    assert block.search(" ".join(copied[:12])) == [(7, 0, 12, 12)]
    # 23 of 28 words is enough, 34 of 44 is not.
    assert block.search(" ".join(copied)) == [(7, 0, 28, 23)]


def test_every_stretch_that_a_seed_hits():
    rng = random.Random(9)
    lost = found = 0
    for n, share in ((30, 0.2), (59, 0.2), (59, 0.25)):
        item = ["i%d" % i for i in range(n)]
        block = dc.Block.of([(1, " ".join(item))])
        for _ in range(100):
            equal = [rng.random() >= share for _ in item]
            text = [w if e else "changed" for w, e in zip(item, equal)]
            seeded = any(all(equal[i + j] for j, keep in enumerate(mask) if keep == "1")
                         for mask in dc.MASKS for i in range(n - len(mask) + 1))
            hit = bool(block.search(" ".join(text)))
            assert hit == (seeded and brute_stretch(equal) >= dc.MIN_EQUAL)
            found += hit
            lost += not hit
    assert found > 100 and lost


def test_ignored_words_do_not_change_a_hash():
    a, b = dc._hashes("a b c d e f g h i".split()), dc._hashes("a b c d X f g h i".split())
    assert (dc.seed_hashes(a, "111101111") == dc.seed_hashes(b, "111101111")).all()
    assert (dc.seed_hashes(a, "111111111") != dc.seed_hashes(b, "111111111")).all()


def test_edges(spark):
    one = [(1, ITEMS[0][1], None), (1, ITEMS[0][1], None), (None, None, None)]
    for items in ([], [(None, "x"), (3, None), (4, ""), (5, "too short")]):
        assert [r["overlaps"] for r in found_items(spark, one, items)] == [[], [], []]
    assert found_items(spark, [], ITEMS) == []
    doubled = found_items(spark, one, [ITEMS[0], ITEMS[0]])
    assert sorted(len(r["overlaps"]) for r in doubled) == [0, 2, 2]


def test_short_nameless_and_unspaced_items(spark):
    six = "one two three four five six"
    rows = [(1, f"before {six} after", "x"), (2, "one two three four five seven", "x"),
            (3, "yes", "x"), (4, "yes it is", "x"), (5, "前の文。これは試験の文章です。後", "x"),
            (6, ITEMS[0][1], "x")]
    items = [(10, six), (11, "yes"), (12, "これは試験の文章です"), (None, ITEMS[0][1])]
    for block_bytes in (1 << 24, 100):
        out = {r["doc_id"]: [(o["item_id"], o["n_equal"]) for o in r["overlaps"]]
               for r in found_items(spark, rows, items, block_bytes=block_bytes)}
        assert out == {1: [(10, 6)], 2: [], 3: [(11, 1)], 4: [], 5: [(12, 10)],
                       6: [(None, len(ITEMS[0][1].split()))]}


def test_items_that_share_a_sentence():
    """2,000 items with one sentence, which a text repeats: one overlap per item."""
    shared = " ".join(sentence(15, 3))
    items = [(i, f"start{i} {shared} end{i}") for i in range(2000)]
    block = dc.Block.of(items)
    started = time.monotonic()
    found = block.search(f"{shared} other words " * 20)
    assert time.monotonic() - started < 10
    assert [f[0] for f in found] == list(range(2000)) and {f[3] for f in found} == {15}


def test_very_long_text():
    filler = " ".join(f"f{i % 977}" for i in range(400_000))
    block = dc.Block.of(ITEMS)
    assert block.search(filler) == []
    found = block.search(f"{filler} {ITEMS[3][1]} {filler}")
    assert [f[0] for f in found] == [3] and found[0][1] == 400_000


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1], "s"), (2, "clean text", "s")],
                                 "doc_id long, text string, overlaps string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = dc.clean(docs, bench)
    assert left.columns == docs.columns
    assert [tuple(r) for r in left.collect()] == [(2, "clean text", "s")]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = dc.op4_decontaminate(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)

    def spaced(text):
        return " " + " ".join(dc.words_of(text)) + " "

    for r in rows:
        whole = {i for i, t in items if spaced(t) in spaced(docs[r["doc_id"]])}
        assert whole <= set(r["item_ids"])
        assert r["contaminated"] == (r["n_items"] > 0) == (r["most_equal"] > 0)
    assert 0 < sum(r["contaminated"] for r in rows) < len(rows) / 4
