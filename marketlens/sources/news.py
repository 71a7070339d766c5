"""News readers and payload flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions.calendar import parse_epoch, parse_lenient
from marketlens.operators.align import concat_frames

# Header synonyms, in order of preference within a group.
HEADER_SYNONYMS = {
    "title": ["title", "headline", "heading"],
    "description": ["description", "text", "body", "article", "content"],
    "published_at": ["published_at", "publishedat", "published", "date", "timestamp"],
    "ticker": ["ticker", "stock", "symbol"],
}


def canonical_news(df: DataFrame) -> DataFrame:
    """Rename headers to the canonical names; several matches coalesce in declared order."""
    by_name = {}
    for column in df.columns:
        by_name.setdefault(column.strip().lower(), column)
    taken, picked = set(), []
    for target, names in HEADER_SYNONYMS.items():
        found = [by_name[n] for n in names if n in by_name]
        if found:
            taken.update(found)
            cols = [F.col(f"`{c}`") for c in found]
            picked.append((cols[0] if len(cols) == 1 else F.coalesce(*cols)).alias(target))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    renamed = df.select(*picked, *rest)
    if "published_at" in renamed.columns:
        renamed = renamed.withColumn("published_at", parse_lenient("published_at"))
    return renamed


def read_news_csv(spark: SparkSession, path: str | list[str],
                  multi_line: bool = True) -> DataFrame:
    """CSV news with flexible headers. All columns are read as strings (no inference pass).

    `multi_line` allows line breaks inside quoted text but makes a file one task; turn it off
    for large single-line files so that they split.
    """
    raw = (spark.read.option("header", True).option("multiLine", multi_line)
           .option("escape", '"').csv(path))
    return canonical_news(raw)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def flatten_articles(payloads: DataFrame, payload: Column | str, *keep: str) -> DataFrame:
    """Rows of `{articles: [...]}` JSON strings; missing fields become empty text, a missing
    or unreadable time becomes null."""
    record = F.from_json(payload, schemas.ARTICLES_PAYLOAD)
    items = payloads.select(*keep, F.inline(record["articles"]))
    fields = ["title", "description", "content"]
    return items.select(
        *keep, *[_text(F.col(f)).alias(f) for f in fields],
        _text(F.col("source.name")).alias("source"), _text(F.col("author")).alias("author"),
        _text(F.col("url")).alias("url"),
        parse_lenient("publishedAt").alias("published_at"))


def read_articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Article payload files, one JSON document per line."""
    return flatten_articles(spark.read.text(path), "value")


def flatten_company_news(payloads: DataFrame, payload: Column | str, ticker: Column | str,
                         *keep: str) -> DataFrame:
    """Rows of company-news JSON arrays, tagged with the instrument; epoch to UTC time."""
    items = payloads.select(
        *keep, (F.col(ticker) if isinstance(ticker, str) else ticker).alias("ticker"),
        F.inline(F.from_json(payload, schemas.COMPANY_NEWS_PAYLOAD)))
    return items.select(
        *keep, _text(F.col("headline")).alias("title"),
        _text(F.col("summary")).alias("description"), _text(F.col("source")).alias("source"),
        _text(F.col("url")).alias("url"),
        parse_epoch(F.coalesce("datetime", F.lit(0))).alias("published_at"), "ticker")


def json_field(column: Column | str, path: str, default: str | None = None) -> Column:
    value = F.get_json_object(column, path)
    return value if default is None else F.coalesce(value, F.lit(default))


def union_news(*sources: DataFrame) -> DataFrame:
    """Bag union of news tables with differing columns; duplicates are kept.

    Times given as text are parsed and instruments become text, so that any reader's output
    goes with any other's.
    """
    return concat_frames(*[_same_types(source) for source in sources])


def _same_types(news: DataFrame) -> DataFrame:
    kinds = dict(news.dtypes)
    same = {}
    if "published_at" in kinds:
        same["published_at"] = (parse_lenient("published_at") if kinds["published_at"] == "string"
                                else F.col("published_at").cast("timestamp_ntz"))
    if "ticker" in kinds:
        same["ticker"] = F.col("ticker").cast("string")
    return news.withColumns(same) if same else news
