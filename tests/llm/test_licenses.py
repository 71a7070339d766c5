"""Licence scan against a search of every template at every place."""

import re

from marketlens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_base(text):
    w, found = words(text), []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    places = [i for i, _ in found]
    return (len(w), len(found), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in found})))


def full_templates(text):
    """Labels whose template stands in the text word for word."""
    w = words(text)
    return {label for label, t, _ in licenses.TEMPLATES
            if any(w[i:i + len(t.split())] == t.split() for i in range(len(w)))}


TEXTS = [
    "Released under the MIT License.", "the mit MIT  license; mit\nLICENSE", "mit licence", "",
    None, "Apache\tLicense Apache-License", "GNU General Public License, version 3. mit license",
    "Licensed under CC BY-NC 4.0.", "general public", "license mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files (the \"Software\"), to deal in the Software",
    "x " * 30_000 + "mit license " + "Mit Licenseé " + "y " * 10,
    "ſ K mit license", "mit license " * 500,
]


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, 7, "n") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, words string")
    return licenses.scan(df.drop("words"))


def test_found_places(spark):
    rows = {r["doc_id"]: r for r in scanned(spark, TEXTS).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, n_base, first, last, labels = brute_base(text)
        base = [f for f in rows[i]["found"] if f["base"]]
        places = [f["place"] for f in base]
        assert (rows[i]["n_words"], len(base)) == (n, n_base), i
        assert (min(places, default=None), max(places, default=None)) == (first, last)
        assert ",".join(sorted({f["label"] for f in base})) == labels
        assert full_templates(text) <= {f["label"] for f in rows[i]["found"]}
        assert all(0 < f["share"] <= 1 for f in rows[i]["found"])
    assert {f["label"] for f in rows[7]["found"]} == {"cc-by-nc"}
    # A text that stops inside the template still holds the key phrase and most of the weight.
    assert {f["label"] for f in rows[10]["found"]} == {"mit"}


def test_key_phrase_is_mandatory(spark):
    text = "permission is hereby granted free of fees to any person obtaining a copy of this " \
           "software and associated documentation files the software to deal in the software"
    assert scanned(spark, [text]).collect()[0]["found"] == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).collect() == []


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = licenses.op3_licenses(spark, sf_dir)
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:6] == brute_base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert any(r["labels"] == "cc-by-nc" for r in rows)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_notice_without_its_rarest_words(spark):
    """A long notice whose rarest words are left out is still proposed by its key phrase."""
    label, template, key = max(licenses.TEMPLATES, key=lambda t: len(t[1].split()))
    w = template.split()
    cut = [x for x in w if x in key.split() or len(x) < 5 or w.index(x) % 9]
    docs = spark.createDataFrame(
        [(1, " ".join(w)), (2, " ".join(w[:len(w) * 3 // 4]))] + [(3, " ".join(cut))],
        "doc_id long, text string")
    out = {r["doc_id"]: {f["label"] for f in r["found"]}
           for r in licenses.scan(docs).collect()}
    assert label in out[1]
    at = next(i for i in range(len(w)) if w[i:i + len(key.split())] == key.split())
    if at + len(key.split()) <= len(w) * 3 // 4:
        assert label in out[2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).collect() == []
