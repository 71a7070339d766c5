"""Join news with bars, and text with lexicon tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.calendar import dated
from marketlens.functions.labels import label_from_return, label_name
from marketlens.functions.text import null_text_to_empty, split_words
from marketlens.operators import lexicon_scan
from marketlens.operators.indicators import forward_return


def filter_ticker(news: DataFrame, tickers: Iterable) -> DataFrame:
    """News of the given instruments; untagged news tables pass through whole."""
    return news.where(F.col("ticker").isin(list(tickers))) if "ticker" in news.columns else news


def with_label(df: DataFrame) -> DataFrame:
    labeled = df.withColumn("label", label_from_return("forward_return"))
    return labeled.withColumn("label_name", label_name("label"))


def filter_labeled(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") >= 0)


def labeled_bars(bars: DataFrame, close: str = "close", **kw) -> DataFrame:
    """Bars with forward return and label; bars without a return are dropped.

    Labelling before the news join keeps the window on the small side and lets the filter
    shrink it.
    """
    return filter_labeled(with_label(forward_return(bars, close=close, **kw)))


def _dated(news: DataFrame, time: str) -> DataFrame:
    return dated(news, time).where(F.col("date").isNotNull())


def align_news_prices(news: DataFrame, bars: DataFrame, *, close: str = "close",
                      time: str = "published_at") -> DataFrame:
    """Inner equi-join of news with labeled bars on instrument and calendar date.

    Bars are unique per key, so the join cannot multiply news. A hot (ticker, date) on the
    news side is split by AQE's skew join, which replicates the matching bar partition.
    """
    return _dated(news, time).join(labeled_bars(bars, close), ["ticker", "date"], "inner")


def align_untagged_news(news: DataFrame, bars: DataFrame, *, close: str = "close",
                        time: str = "published_at") -> DataFrame:
    """Untagged news against every instrument's bar of its day.

    The row-level result grows with news x instruments; prefer `align_untagged_counts` when
    only label totals are needed.
    """
    untagged = _dated(news, time).drop("ticker")
    return untagged.join(labeled_bars(bars, close), "date", "inner")


def align_untagged_counts(news: DataFrame, bars: DataFrame, *, close: str = "close",
                          time: str = "published_at") -> DataFrame:
    """The same alignment factorised: each labeled bar with the number of headlines paired.

    News is counted per day before the join, so the pairs are never materialised and the
    counted side is bounded by the number of days.
    """
    per_day = _dated(news, time).groupBy("date").agg(F.count(F.lit(1)).alias("n_news"))
    return labeled_bars(bars, close).join(per_day, "date", "inner")


def token_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Distinct white-space tokens of the lower-cased text, one row each."""
    words = F.array_distinct(split_words(F.lower(null_text_to_empty(text))))
    return df.select(*keep, F.explode(words).alias("term"))


def lexicon_token_join(df: DataFrame, lexicon: DataFrame, text: str,
                       keep: list[str]) -> DataFrame:
    """Tokens that are lexicon terms. The lexicon's size decides the join strategy."""
    return token_rows(df, text, keep).join(lexicon, "term", "inner")


def lexicon_substring_join(df: DataFrame, terms: DataFrame, text: str,
                           keep: list[str]) -> DataFrame:
    """(row, term) for each entry of `terms` (term) contained in the text, without a join."""
    hits = lexicon_scan.contained_terms(df.select(*keep, text), text, terms, "_hits")
    return hits.select(*keep, F.explode("_hits").alias("term"))


def stopword_anti(tokens: DataFrame, stop_words: DataFrame, term: str = "term") -> DataFrame:
    """Rows whose term is not in the stop table; one-character terms go too."""
    kept = tokens.where(F.length(term) > 1)
    return kept.join(stop_words.select(F.col("term").alias(term)), term, "left_anti")


def weight_join(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach per-class weights; the weight table has one row per class."""
    return df.join(weights.select(label, "weight"), label, "left")


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Bag union by name; missing columns become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def fill_all(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)),
                                         F.lit(0.0)) for c in columns})


def token_table(df: DataFrame, tokens: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(tokens).alias("pos", "term"))
