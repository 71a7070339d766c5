"""Base counts against plain Python; the classifier on rows it has not seen."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(marked))


def counted(text):
    text, data, words, ids, _ = quality._prepared(text)
    return quality.base_counts(text, data, words, ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", "c\n", "\x1c", " x"]), max_size=60))
def test_base_counts(parts):
    text = " ".join(parts)
    assert counted(text) == brute(text)


def test_base_counts_of_odd_texts():
    for text in [None, "", " \n\x0b", "a" * 70_000, "x y z w " * 9, "l\nl\n\n \nl \r\n", "|" * 9]:
        assert counted(text) == brute(text)
    long = " ".join(str(i % 5003) for i in range(30_000))
    assert counted(long)[4] == 30_000


def test_margin_equals_feature_product():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.SIZE).astype(np.float32), 0.3, 1.0, 0.0)
    for text in ["", "ab", "one two three two", "é" * 50]:
        _, data, _, ids, distinct = quality._prepared(text)
        at, value = quality.features(data, ids, distinct)
        assert abs(quality.margin(model, data, ids, distinct)
                   - (model.weights[at] @ value + 0.3)) < 1e-5


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
        bad = i % 3 == 0
        out.append((seed * 10_000 + i, " ".join(w.upper() + "!!" if bad else w for w in words),
                    0 if bad else 1))
    return out


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data],
                                 "doc_id long, text string, kept string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark):
    model = quality.fit(*frames(spark, rows(300, 1)))
    docs, labels = frames(spark, rows(150, 2))
    out = quality.score(docs, model).join(labels, "doc_id").collect()
    assert len(out) == 150
    assert np.mean([(r["p_good"] >= 0.5) == (r["quality"] == 1) for r in out]) > 0.98
    assert abs(np.mean([r["p_good"] for r in out]) - 2 / 3) < 0.1
    bounded = quality.fit(*frames(spark, rows(300, 1)), fit_rows=100)
    assert bounded is not None and not np.array_equal(bounded.weights, model.weights)


def test_edges(spark):
    docs, labels = frames(spark, rows(30, 3))
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.fit(docs.limit(0), labels) is None
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "w" + " word" * 30)],
                                "doc_id long, text string")
    scored = quality.score(odd, None).collect()
    assert sorted((r["n_words"], r["base_failed"], r["kept"]) for r in scored) == [
        (0, True, False)] * 3 + [(31, True, False)]
    nulls = labels.union(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    assert quality.fit(docs, nulls) is not None
    assert quality.score(odd.limit(0), None).collect() == []


def test_repeated_ids_are_bounded_before_the_driver(spark):
    """One id holds most rows; the fit takes no more than its bound."""
    good = "a quiet morning in the village with bread and coffee on the table "
    docs = spark.range(3000).select((F.col("id") % 30 == 0).cast("long").alias("doc_id"),
                                    F.concat(F.lit(good), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, fit_rows=200) is not None


def test_keep_good_keeps_columns(spark):
    docs, labels = frames(spark, rows(90, 4))
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns
    got = left.collect()
    assert {r["kept"] for r in got} == {"x"} and 50 <= len(got) <= 65


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = quality.op9_quality(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        assert tuple(r)[1:6] == brute(docs[r["doc_id"]]) if len(docs[r["doc_id"]]) < 9000 else 1
        assert r["base_failed"] == (r["n_words"] < 20
                                    or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]] == 1, r["kept"]) for r in found
              if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([a == b for a, b in judged]) > 0.95
