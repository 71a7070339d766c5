"""Sentiment, market and calendar columns; `headline_model` assembles them with the terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.calendar import TEMPORAL_FEATURES, temporal_features
from marketlens.functions.lexicon import (
    add_valence, emphasis, lexicon_count, polarity, subjectivity, tallied_scores)
from marketlens.lexicons import DEFAULT_LEXICON, Lexicon
from marketlens.operators import word_scores
from marketlens.operators.indicators import MARKET_FEATURES
from marketlens.operators.lexicon_scan import CLASSES, scan

SENTIMENT_FEATURES = [
    "sentiment_polarity", "sentiment_subjectivity", "sentiment_intensity",
    "polarity_x_subjectivity", "bullish_keyword_count", "bearish_keyword_count",
    "neutral_keyword_count", "keyword_sentiment", "neutral_signal", "valence_compound",
    "valence_positive", "valence_negative", "valence_neutral"]


def sentiment_features(df: DataFrame, text: str, match_text: Column | None = None,
                       valence_text: str | None = None,
                       lexicon: Lexicon | DataFrame = DEFAULT_LEXICON) -> DataFrame:
    """Append the 13 sentiment columns, all row-local.

    `match_text` overrides the text used for lexicon counts (inference counts over raw and
    clean text); `valence_text` the one scored by the valence rules. A `Lexicon` is inlined
    as literals, a lexicon table of any size is scanned in blocks.
    """
    source = F.col(text) if match_text is None else match_text
    valence_text = valence_text or text
    if isinstance(lexicon, Lexicon):
        base = df.withColumns({
            "sentiment_polarity": polarity(text, lexicon),
            "sentiment_subjectivity": subjectivity(text, lexicon),
            **{f"{c}_keyword_count": lexicon_count(source, c, lexicon) for c in CLASSES}})
    else:
        names = {"sentiment_polarity": "polarity", "sentiment_subjectivity": "subjectivity",
                 **{f"{c}_keyword_count": f"{c}_count" for c in CLASSES}}
        found = scan(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_own"),
                               source.alias("_match")), "_match", lexicon, token_text="_own")
        base = found.select("_row.*", *[F.col(c).alias(n) for n, c in names.items()])
    return _derived(add_valence(base, valence_text, "_v"))


def sentiment_in_batches(df: DataFrame, text: str, lexicon: Lexicon = DEFAULT_LEXICON
                         ) -> DataFrame:
    """`sentiment_features` of one text, several times as fast: the words are looked up in Arrow
    batches, and what is rounded or divided is computed by the same expressions."""
    found = word_scores.append_sums(df, text, "_sums", lexicon)
    mean = {f"sentiment_{c}": F.coalesce(F.try_divide(f"_sums.{c}", "_sums.hits"), F.lit(0.0))
            for c in ("polarity", "subjectivity")}
    counts = {f"{c}_keyword_count": F.col(f"_sums.{c}") for c in CLASSES}
    score = tallied_scores(F.col("_sums"), F.col("_sums.words"), emphasis(text))
    return _derived(found.withColumns({**mean, **counts, "_v": score})).drop("_sums")


def _derived(base: DataFrame) -> DataFrame:
    return base.withColumns({
        "sentiment_intensity": F.abs("sentiment_polarity"),
        "polarity_x_subjectivity": F.col("sentiment_polarity") * F.col("sentiment_subjectivity"),
        "keyword_sentiment": F.col("bullish_keyword_count") - F.col("bearish_keyword_count"),
        "neutral_signal": (F.col("neutral_keyword_count") > 0).cast("int"),
        "valence_compound": F.col("_v.compound"), "valence_positive": F.col("_v.positive"),
        "valence_negative": F.col("_v.negative"), "valence_neutral": F.col("_v.neutral"),
    }).drop("_v")


def add_temporal_features(df: DataFrame, time: str = "published_at") -> DataFrame:
    return df.select("*", *temporal_features(time))


def scalar_features(df: DataFrame, text: str, time: str | None = "published_at",
                    lexicon: Lexicon = DEFAULT_LEXICON) -> tuple[DataFrame, list[str]]:
    """Sentiment, market (when present) and calendar columns without the term block."""
    wide = sentiment_features(df, text, lexicon=lexicon)
    names = [*SENTIMENT_FEATURES, *[c for c in MARKET_FEATURES if c in df.columns]]
    if time and time in df.columns:
        wide = add_temporal_features(wide, time)
        names += TEMPORAL_FEATURES
    return wide, names
