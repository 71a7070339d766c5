"""Lexicon and valence sentiment as Column expressions."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.text import _col, contained_terms, null_text_to_empty, split_words
from marketlens.lexicons import (
    DAMPENERS, DEFAULT_LEXICON, DEFAULT_VALENCE, INTENSIFIERS, NEGATIONS, Lexicon)


def lookup(token: Column, table: Mapping[str, float]) -> Column:
    """Literal lookup: one CASE branch per distinct value, each a hash-set probe."""
    by_value: dict[float, list[str]] = {}
    for term, value in table.items():
        by_value.setdefault(float(value), []).append(term)
    chain = None
    for value, terms in sorted(by_value.items()):
        hit = token.isin(sorted(terms))
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain


def combined_text(raw: Column | str, clean: Column | str) -> Column:
    """Inference-time matching text: raw and clean text, lower-cased."""
    return F.lower(F.concat(null_text_to_empty(raw), F.lit(" "), null_text_to_empty(clean)))


def lexicon_count(text: Column | str, label: str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Distinct terms of a class found in the text.

    A token hit is also a substring hit, so token hits plus substring hits of the remaining
    terms equals the number of contained terms.
    """
    return F.size(contained_terms(F.lower(null_text_to_empty(text)), lexicon.terms(label)))


def lower_words(text: Column | str) -> Column:
    """White-space tokens of the lower-cased text."""
    return split_words(F.lower(null_text_to_empty(text)))


def word_hits(words: Column | str, terms: list[str]) -> Column:
    """Distinct words that are in `terms`."""
    return F.size(F.array_distinct(F.filter(_col(words), lambda w: w.isin(terms))))


def token_hits(text: Column | str, terms: list[str]) -> Column:
    """Distinct white-space tokens of the lower-cased text that are in `terms`."""
    return word_hits(lower_words(text), terms)


def _mean_weight(words: Column, table: Mapping[str, float]) -> Column:
    hits = F.filter(words, lambda w: w.isin(sorted(table)))
    total = F.aggregate(hits, F.lit(0.0), lambda acc, w: acc + lookup(w, table))
    return F.coalesce(F.try_divide(total, F.size(hits)), F.lit(0.0))


def word_polarity(words: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return _mean_weight(_col(words), {t: w[0] for t, w in lexicon.weights().items()})


def polarity(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Mean polarity of the lexicon tokens in the text; 0 without a hit."""
    return word_polarity(lower_words(text), lexicon)


def subjectivity(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return _mean_weight(lower_words(text), {t: w[1] for t, w in lexicon.weights().items()})


# Constants of the published valence rules.
BOOST = 0.293
DAMPING = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MAX_QUESTION = 0.18, 0.96
NORMALISER = 15.0
CAPITALS = 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EDGE_PUNCTUATION = r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
ALPHANUMERIC = list(string.ascii_letters + string.digits)


def valence_words(text: Column | str) -> Column:
    """White-space tokens without edge punctuation and apostrophes."""
    bare = split_words(F.translate(null_text_to_empty(text), "'’", ""))
    # Most tokens have clean edges, which costs two probes and no pattern.
    words = F.transform(bare, lambda w: F.when(
        F.substring(w, 1, 1).isin(ALPHANUMERIC) & F.substring(w, -1, 1).isin(ALPHANUMERIC), w)
        .otherwise(F.regexp_replace(w, EDGE_PUNCTUATION, "")))
    return F.filter(words, lambda w: w != F.lit(""))


def in_capitals(word: Column) -> Column:
    return (F.lower(word) != word) & (F.upper(word) == word)


def marked_words(words: Column | str, valence: Mapping[str, float] = DEFAULT_VALENCE) -> Column:
    """array<struct<i, w, upper>>: place, lower-cased form and capitals of the words that any
    rule looks at. All further steps run over these few only."""
    known = sorted({*valence, *INTENSIFIERS, *DAMPENERS, *NEGATIONS, "but"})
    return F.array_compact(F.transform(_col(words), lambda w, i: F.when(
        F.lower(w).isin(known), F.struct(
            i.alias("i"), F.lower(w).alias("w"), in_capitals(w).alias("upper")))))


def word_facts(marked: str, plain: str, valence: Mapping[str, float] = DEFAULT_VALENCE) -> Column:
    """Per word of `marked_words`: valence `v` and booster `b`, both raised for stressed
    words, negation `n`, and whether it is the contrasting conjunction. Capitals stress only
    if some word of the text is `plain`."""
    modifiers = {**{w: BOOST for w in INTENSIFIERS}, **{w: -BOOST for w in DAMPENERS}}

    def known(word: Column, table: Mapping[str, float]) -> Column:
        # One probe settles the common case of a word in no table.
        return F.when(word.isin(sorted(table)), lookup(word, table)).otherwise(F.lit(0.0))

    def fact(token: Column) -> Column:
        v, b = known(token["w"], valence), known(token["w"], modifiers)
        stressed = token["upper"] & F.col(plain)
        return F.struct(
            token["i"].alias("i"),
            F.when(stressed & (v > 0), v + CAPITALS).when(stressed & (v < 0), v - CAPITALS)
            .otherwise(v).alias("v"),
            F.when(stressed & (b != 0), b + CAPITALS).otherwise(b).alias("b"),
            token["w"].isin(NEGATIONS).alias("n"), (token["w"] == "but").alias("but"))

    return F.transform(_col(marked), fact)


def contrast(facts: str) -> Column:
    """Place of the first "but", or null."""
    return F.get(F.filter(facts, lambda f: f["but"]), F.lit(0))["i"]


def hit_valences(facts: str, contrast_at: str) -> Column:
    """Valences of the words that have one, after boosters and negation in the three
    preceding words and after the contrast: what stands before the first "but" counts half,
    what follows half as much again. `facts` and `contrast_at` must be columns: they are read
    around every hit."""
    order = F.transform(facts, lambda f, j: F.when(f["v"] != 0, j))
    but = F.col(contrast_at)

    def adjusted(j: Column) -> Column:
        own, i = F.get(facts, j)["v"], F.get(facts, j)["i"]
        sign = F.when(own < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        boosted, negated = own, F.lit(False)
        # The three preceding words hold at most the three preceding marked ones.
        for k in range(1, len(DAMPING) + 1):
            earlier = F.get(facts, j - k)
            damping = F.when(earlier["i"] == i - 1, F.lit(DAMPING[0]))
            for distance, factor in enumerate(DAMPING[1:], start=2):
                damping = damping.when(earlier["i"] == i - distance, F.lit(factor))
            boosted = boosted + F.coalesce(sign * earlier["b"] * damping, F.lit(0.0))
            negated = negated | F.coalesce(
                earlier["n"] & (earlier["i"] >= i - len(DAMPING)), F.lit(False))
        total = F.when(negated, boosted * F.lit(NEGATION_FACTOR)).otherwise(boosted)
        return (F.when(i < but, total * BEFORE_BUT).when(i > but, total * AFTER_BUT)
                .otherwise(total))

    return F.transform(F.array_compact(order), adjusted)


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def emphasis(text: Column | str) -> Column:
    text = null_text_to_empty(text)
    bangs = F.least(_occurrences(text, "!"), F.lit(MAX_EXCLAMATIONS))
    marks = _occurrences(text, "?")
    asked = (F.when(marks > 3, F.lit(MAX_QUESTION)).when(marks > 1, marks * F.lit(QUESTION))
             .otherwise(F.lit(0.0)))
    return bangs * F.lit(EXCLAMATION) + asked


def _toward(total: Column, amount: Column) -> Column:
    return (F.when(total > 0, total + amount).when(total < 0, total - amount)
            .otherwise(total))


def valence_scores(hits: Column | str, n_words: Column, amount: Column) -> Column:
    """struct(compound, positive, negative, neutral) from `hit_valences`, the number of
    words and the `emphasis` of the raw text."""
    hits = _col(hits)
    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"),
                    F.lit(0).alias("n"))
    tally = F.aggregate(hits, zero, lambda t, v: F.struct(
        (t["all"] + v).alias("all"),
        (t["pos"] + F.when(v > 0, v + 1).otherwise(F.lit(0.0))).alias("pos"),
        (t["neg"] + F.when(v < 0, v - 1).otherwise(F.lit(0.0))).alias("neg"),
        (t["n"] + F.when(v != 0, 1).otherwise(0)).alias("n")))
    return tallied_scores(tally, n_words, amount)


def tallied_scores(tally: Column, n_words: Column, amount: Column) -> Column:
    """`valence_scores` from the sums over the hits: of all, of the raised positive and negative
    ones, and their number."""
    bound = F.struct(tally.alias("t"), amount.alias("amount"), n_words.alias("words"))

    def scores(row: Column) -> Column:
        t, extra = row["t"], row["amount"]
        s = _toward(t["all"], extra)
        pos = F.when(t["pos"] > -t["neg"], t["pos"] + extra).otherwise(t["pos"])
        neg = F.when(t["pos"] < -t["neg"], t["neg"] - extra).otherwise(t["neg"])
        neu = (row["words"] - t["n"]).cast("double")
        mass = pos - neg + neu

        def share(x: Column) -> Column:
            return F.round(F.coalesce(F.try_divide(x, mass), F.lit(0.0)), 3)

        return F.struct(
            F.round(s / F.sqrt(s * s + F.lit(NORMALISER)), 4).alias("compound"),
            share(pos).alias("positive"), share(-neg).alias("negative"),
            share(neu).alias("neutral"))

    return F.transform(F.array(bound), scores)[0]


def add_valence(df: DataFrame, text: str, output: str = "valence",
                valence: Mapping[str, float] = DEFAULT_VALENCE) -> DataFrame:
    """Append struct `output` of compound, positive, negative and neutral scores."""
    staged = df.withColumn("_tokens", valence_words(text)).withColumns({
        "_plain": F.exists("_tokens", lambda w: ~in_capitals(w)),
        "_marked": marked_words("_tokens", valence), "_words": F.size("_tokens"),
        "_emphasis": emphasis(text)})
    staged = staged.withColumn("_facts", word_facts("_marked", "_plain", valence))
    staged = staged.withColumn("_but", contrast("_facts"))
    staged = staged.withColumn("_hits", hit_valences("_facts", "_but"))
    score = valence_scores("_hits", F.col("_words"), F.col("_emphasis"))
    return staged.withColumn(output, score).drop(
        "_tokens", "_plain", "_marked", "_words", "_emphasis", "_facts", "_but", "_hits")


def sentiment_label(compound: Column | str, cut: float = 0.05) -> Column:
    compound = _col(compound)
    return (F.when(compound >= cut, F.lit("positive")).when(compound <= -cut, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def sentiment_band(value: Column | str, band: float = params.POLARITY_BAND) -> Column:
    value = _col(value)
    return (F.when(value < -band, F.lit("negative")).when(value < band, F.lit("neutral"))
            .when(value.isNotNull(), F.lit("positive")))
