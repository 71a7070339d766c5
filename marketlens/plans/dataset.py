"""End-to-end dataset plan: news x bars, labeled, in one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.text import clean_text, finance_keywords
from marketlens.operators.align import align_news_prices, align_untagged_news, filter_ticker
from marketlens.sources.prices import multi_ticker
from marketlens.sources.sinks import write_dataset


def build_dataset(news: DataFrame, bars: DataFrame,
                  tickers: Iterable | None = params.DEFAULT_TICKERS, start: str = "2020-01-01",
                  end: str | None = None, save_to: str | None = None,
                  close: str = "close") -> DataFrame:
    """All instruments in one join; untagged news pairs with every instrument of its day.

    `tickers=None` takes every instrument in `bars`.
    """
    chosen = list(tickers) if tickers is not None else None
    prices = multi_ticker(bars, chosen, start, end)
    if "ticker" in news.columns:
        tagged = filter_ticker(news, chosen) if chosen is not None else news
        dataset = align_news_prices(tagged, prices, close=close)
    else:
        dataset = align_untagged_news(news, prices, close=close)
    if save_to:
        write_dataset(dataset, save_to, partition_by="date")
    return dataset


def preprocess(df: DataFrame, text: str = "title", output: str = "clean_text") -> DataFrame:
    """Clean text, domain keywords and their count."""
    cleaned = df.withColumns({output: clean_text(text),
                              "financial_keywords": finance_keywords(text)})
    return cleaned.withColumn("n_financial_keywords", F.size("financial_keywords"))
