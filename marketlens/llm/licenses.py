"""Licence notices by a positional index of rare template words.

A template is a licence text or notice as a word list. Its rarest words, by inverse document
frequency over the whole corpus, are its anchors and form an index from word to (template,
position). An anchor word at place i of a file proposes that a template starts at i minus the
anchor's position. Each distinct proposal is checked once: all postings of the template are
intersected with the file at that relative position, weighted by rarity, and the template's
mandatory key phrase must stand there word for word.

The whole search happens inside the row, so no posting is shuffled; only document frequencies
of template words are aggregated, whose number the templates bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import lower_ascii, table

#: Fixed values: (label, phrase) counted as base places.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: (label, template, key phrase inside it): openings and notices of public licences.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software without "
     "restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a "
     "copy of the license at", "except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free "
     "software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free "
     "software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
     "or without fee is hereby granted", "distribute this software for any purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc", "this work is licensed under a creative commons attribution license",
     "creative commons attribution"),
]
#: Rarest words of each template that propose places.
ANCHORS = 3
#: Share of a template's rarity weight that must stand at the proposed place.
MATCH = 0.6
# A proposal is template << 40 | place + 2^32, so that places before the text stay positive.
_PLACE, _ORIGIN = 2**40, 2**32


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, ASCII letters and characters beyond ASCII; null: none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _all_templates() -> list[tuple[str, list[str], list[str], bool]]:
    """(label, words, key words, is base): a base phrase is a template of its own."""
    return ([(label, p.split(), p.split(), True) for label, p in BASE]
            + [(label, t.split(), k.split(), False) for label, t, k in TEMPLATES])


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of `words` and, for each word of `vocabulary`, the rows that hold it.

    At most one count per vocabulary word comes to the driver.
    """
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counts = {r["w"]: r["n"] for r in
              words.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w"))
              .groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), counts


def _literal(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return f"'{value}'" if isinstance(value, str) else (
        f"{value}L" if isinstance(value, int) else f"double('{value!r}')")


def scan(docs: DataFrame, match: float = MATCH, anchors: int = ANCHORS) -> DataFrame:
    """`docs` with n_words and `found`, an array of (label, base, place, share) per notice.

    `place` is the word at which the template starts; it is negative if the text begins
    inside the template. Null and empty texts have no words and no notices; repeated rows are
    scanned each, and notices with equal places are all listed. Texts are scanned whole, at
    any length. An empty table gives no rows. Columns of `docs` called n_words or found are
    replaced.
    """
    templates = _all_templates()
    names = [c for c in docs.columns if c not in ("n_words", "found")]
    worded = docs.select(*(docs[c] for c in names), words_of(docs["text"]).alias("words"))
    vocabulary = sorted({w for _, words, _, _ in templates for w in words})
    rows, df = document_frequencies(worded.select("words"), vocabulary)
    idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}

    index: dict[str, list[int]] = {}
    for t, (_, words, key, _) in enumerate(templates):
        # Words that some document holds, the rarest first. A notice has to hold the key
        # phrase, so with the phrase's rarest word among the anchors none is overlooked.
        known = sorted([w for w in set(words) if df.get(w)] or set(words),
                       key=lambda w: (-idf[w], w))
        rare = {*known[:anchors], *[w for w in known if w in key][:1]}
        for place, word in enumerate(words):
            if word in rare:
                index.setdefault(word, []).append(t * _PLACE + _ORIGIN - place)
    postings = F.expr("map(" + ", ".join(
        f"{_literal(w)}, {_literal(p)}" for w, p in sorted(index.items())) + ")")
    texts = F.expr(_literal([words for _, words, _, _ in templates]))
    weights = F.expr(_literal([[idf[w] / sum(idf[v] for v in words) for w in words]
                               for _, words, _, _ in templates]))
    spans = []
    for _, words, key, _ in templates:
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        spans.append((at, at + len(key) - 1))
    keys = F.expr("array(" + ", ".join(f"array({a}, {b})" for a, b in spans) + ")")
    labels = F.expr(_literal([label for label, _, _, _ in templates]))
    bases = F.expr("array(" + ", ".join(str(b).lower() for *_, b in templates) + ")")

    at_anchor = F.array_compact(F.transform(
        "words", lambda w, i: F.when(w.isin(sorted(index)), i)))
    proposals = F.array_distinct(F.flatten(F.transform(at_anchor, lambda i: F.transform(
        F.element_at(postings, F.get("words", i)), lambda p: p + i))))

    def stands(t: Column, place: Column, p: Column) -> Column:
        """Whether word p of template t stands in the file when the template starts at place."""
        return F.coalesce(F.get("words", place + p) == F.get(F.get(texts, t), p), F.lit(False))

    def checked(code: Column) -> Column:
        t = F.shiftright(code, 40).cast("int")
        place = (code % _PLACE - _ORIGIN).cast("int")
        share = F.aggregate(
            F.sequence(F.lit(0), F.size(F.get(texts, t)) - 1), F.lit(0.0),
            lambda total, p: total + F.when(stands(t, place, p), F.get(F.get(weights, t), p))
            .otherwise(0.0))
        key = F.get(keys, t)
        whole_key = F.forall(F.sequence(F.get(key, F.lit(0)), F.get(key, F.lit(1))),
                             lambda p: stands(t, place, p))
        return F.struct(F.get(labels, t).alias("label"), F.get(bases, t).alias("base"),
                        place.alias("place"), F.round(share, 6).alias("share"),
                        whole_key.alias("whole_key"))

    accepted = F.filter(F.transform("proposals", checked),
                        lambda x: x["whole_key"] & (x["share"] >= match))
    return (worded.withColumn("proposals", proposals)
            .select(*names, F.size("words").cast("long").alias("n_words"),
                    F.transform(accepted, lambda x: x.dropFields("whole_key")).alias("found")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = scan(table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("found", lambda x: x["base"])
    places = F.transform(base, lambda x: x["place"].cast("long"))

    def joined(notices: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(
            F.transform(notices, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
        .alias("score"))
