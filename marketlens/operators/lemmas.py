"""Token-to-lemma table against a vocabulary too large to inline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.lexicons import NOUN_SUFFIXES


def _rewrite(word: Column, suffix: str, ending: str) -> Column:
    return F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(ending))


def lemma_table(tokens: DataFrame, vocabulary: DataFrame, term: str = "term",
                unique: bool = False) -> DataFrame:
    """Per distinct token: the shortest vocabulary entry among it and its suffix rewrites.

    A lemma depends on the token alone, so tokens are made distinct first, unless they are
    `unique` already. A token without a rewrite is its own lemma whatever the vocabulary holds;
    only the others meet it.
    """
    word = F.col("token")
    distinct = tokens.select(F.col(term).alias("token"))
    if not unique:
        distinct = distinct.distinct()
    suffixes = "|".join(a for a, _ in NOUN_SUFFIXES)
    inflected = F.coalesce(word.rlike(rf"(?:{suffixes})\z"), F.lit(False))
    forms = [word, *(_rewrite(word, a, b) for a, b in NOUN_SUFFIXES)]
    fits = [F.lit(True), *(word.endswith(a) for a, _ in NOUN_SUFFIXES)]
    # Length and place in the list, as one number that a hash aggregate can hold.
    turns = len(forms)
    tried = distinct.where(inflected).select("token", F.inline(F.array_compact(F.array(*[
        F.when(fit, F.struct(form.alias("lemma"), (F.length(form) * turns + turn).alias("rank")))
        for turn, (fit, form) in enumerate(zip(fits, forms))]))))
    known = vocabulary.select(F.col("term").alias("lemma")).distinct().withColumn("known", F.lit(1))
    best = (tried.join(known, "lemma", "left").groupBy("token")
            .agg(F.min(F.when(F.col("known") == 1, F.col("rank"))).alias("rank")))
    own = F.coalesce(F.col("rank") % turns, F.lit(0))
    lemma = reduce(lambda chain, turn: chain.when(own == turn, forms[turn]),
                   range(1, turns), F.when(own == 0, word))
    return (best.select("token", lemma.alias("lemma"))
            .unionByName(distinct.where(~inflected).select("token", word.alias("lemma"))))
