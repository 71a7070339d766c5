"""Registered queries on sources, sinks, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from marketlens.functions import lexicon as lex
from marketlens.functions import text as tx
from marketlens.functions.calendar import epoch_seconds
from marketlens.functions.labels import percent
from marketlens.operators import align, heuristic, reports, vocabulary
from marketlens.plans import sql as s
from marketlens.plans.dataset import build_dataset
from marketlens.plans.learn_queries import HEUR_VIEWS, P
from marketlens.plans.market_queries import ALIGNED, NAMED, TO_DAY
from marketlens.plans.tables import (
    bars, headlines, headlines_from, printable, rounded, spread, spread_headlines, table,
    ticks_bars)
from marketlens.plans.text_queries import VOCAB, _clean_docs
from marketlens.sources import news, prices, sinks
from marketlens.sources.workspace import new_path
from marketlens.streaming import streams

QUERIES, SQL = {}, {}


def query(key: str, twin: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if twin is not None:
            SQL[key] = twin
        return fn
    return register


NOW = "strftime(published_at, '%Y-%m-%d %H:%M:%S')"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- news ------------------------------------------------------------------------------------

CSV_NEWS = f"""SELECT title, 'row ' || id || chr(10) || 'says "' || title || '"' AS description,
                      CASE WHEN id % 9 = 0 THEN NULL ELSE {NOW} END AS published_at,
                      CAST(ticker AS VARCHAR) AS ticker FROM headlines"""
ARTICLES = f"""SELECT title, '' AS description, 'body ' || id AS content,
                      'feed ' || (ticker % 5) AS source, '' AS author, 'u/' || id AS url,
                      {NOW} AS published_at FROM headlines"""
COMPANY_NEWS = f"""SELECT title, CASE WHEN id % 3 = 0 THEN '' ELSE 'sum ' || id END AS description,
                          'feed' AS source, '' AS url, {NOW} AS published_at, ticker
                   FROM headlines"""


def _csv_news(spark, sf):
    """Written with synonym headers, quotes and line breaks; then read through the loader."""
    feed = spread_headlines(spark, sf).select(
        F.col("title").alias("Headline"),
        F.concat(F.lit("row "), "id", F.lit('\nsays "'), "title", F.lit('"')).alias("Text"),
        F.when(F.col("id") % 9 == 0, F.lit("unknown")).otherwise(_stamp("published_at"))
        .alias("Date"), F.col("ticker").alias("Symbol"))
    path = new_path(spark, "news-csv")
    sinks.write_csv(feed, path)
    return news.read_news_csv(spark, path)


def _paged(spark, sf, *keys: str, size: int = 100):
    """Headlines with their page of `size` in a feed, dealt by `keys` and page.

    Lists are collected where the rows are: before an exchange a task would make, sort and
    send a list of one or two items for nearly every row.
    """
    page = F.floor(F.col("id") / size).alias("page")
    return spread(headlines(spark, sf).select("*", page), *keys, "page")


def _articles(spark, sf):
    article = F.struct(
        "title", F.concat(F.lit("body "), "id").alias("content"),
        F.struct(F.concat(F.lit("feed "), F.col("ticker") % 5).alias("name")).alias("source"),
        F.concat(F.lit("u/"), "id").alias("url"), _stamp("published_at").alias("publishedAt"))
    pages = _paged(spark, sf).groupBy("page").agg(F.collect_list(article).alias("items"))
    payloads = pages.select(F.to_json(F.struct(F.col("items").alias("articles"))).alias("body"))
    path = new_path(spark, "articles")
    payloads.write.text(path)
    return news.read_articles(spark, path)


def _company_news(spark, sf):
    item = F.struct(
        F.col("title").alias("headline"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("sum "), "id")).alias("summary"),
        F.lit("feed").alias("source"), epoch_seconds("published_at").alias("datetime"))
    payloads = (_paged(spark, sf, "ticker").groupBy("ticker", "page")
                .agg(F.to_json(F.collect_list(item)).alias("body")))
    return news.flatten_company_news(payloads, "body", "ticker")


@query("src_news_csv", s.twin(CSV_NEWS, "headlines"))
def src_news_csv(spark, sf):
    return printable(_csv_news(spark, sf))


@query("src_articles_json", s.twin(ARTICLES, "headlines"))
def src_articles_json(spark, sf):
    return printable(_articles(spark, sf))


@query("src_company_news_json", s.twin(COMPANY_NEWS, "headlines"))
def src_company_news_json(spark, sf):
    return printable(_company_news(spark, sf))


@query("src_news_union", s.twin(
    f"""SELECT title, description, content, source, author, url, published_at, NULL AS ticker
        FROM ({ARTICLES})
        UNION ALL SELECT title, description, NULL, source, NULL, url, published_at,
                         CAST(ticker AS VARCHAR) FROM ({COMPANY_NEWS})
        UNION ALL SELECT title, description, NULL, NULL, NULL, NULL, published_at, ticker
        FROM ({CSV_NEWS})""", "headlines"))
def src_news_union(spark, sf):
    """Three sources with differing columns and types, each through its reader."""
    return printable(news.union_news(_articles(spark, sf), _company_news(spark, sf),
                                     _csv_news(spark, sf)))


@query("concat_frames", s.twin(
    f"""SELECT {TO_DAY}, close, volume, NULL AS open FROM bars
        UNION ALL SELECT {TO_DAY}, close, NULL, open FROM ticks_bars""", "bars", "ticks_bars"))
def concat_frames(spark, sf):
    return printable(align.concat_frames(
        bars(spark, sf).select("ticker", "date", "close", "volume"),
        ticks_bars(spark, sf).select("ticker", "date", "close", "open")))


@query("json_extract", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events""")
def json_extract(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", news.json_field("props", "$.k").cast("long").alias("k"),
                         news.json_field("props", "$.missing", "").alias("missing"))


# --- prices ----------------------------------------------------------------------------------

@query("src_quote_json", """
    SELECT event_id, round(value, 2) AS current, CAST(NULL AS DOUBLE) AS high,
           floor(value) AS low, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ceil(value) END AS open,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value, 2) END AS prev_close,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM events""")
def src_quote_json(spark, sf):
    value = F.round("value", 2)
    record = F.to_json(F.struct(
        value.alias("c"), F.when(F.col("event_id") % 4 != 0, value).alias("pc"),
        F.floor("value").cast("double").alias("l"),
        F.when(F.col("event_id") % 5 != 0, F.ceil("value").cast("double")).alias("o"),
        epoch_seconds("ts").alias("t")))
    payloads = table(spark, sf, "events").select("event_id", record.alias("body"))
    return printable(prices.flatten_quote(payloads, "body", "event_id"))


@query("src_market_quote_json", """
    SELECT event_id, round(value, 2) AS price, round(value - 50, 2) AS change,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value - 50, 2) END AS change_pct,
           event_id * 10 AS volume FROM events""")
def src_market_quote_json(spark, sf):
    """The second quote shape, with a missing percent change now and then."""
    change = F.round(F.col("value") - 50, 2)
    record = F.to_json(F.struct(
        F.round("value", 2).alias("regularMarketPrice"), change.alias("regularMarketChange"),
        F.when(F.col("event_id") % 3 != 0, change).alias("regularMarketChangePercent"),
        (F.col("event_id") * 10).alias("regularMarketVolume")))
    payloads = table(spark, sf, "events").select("event_id", record.alias("body"))
    return prices.flatten_market_quote(payloads, "body", "event_id")


@query("src_daily_series_json", s.twin(
    f"""SELECT {TO_DAY}, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close,
               CAST(volume AS DOUBLE) AS volume FROM ticks_bars""", "ticks_bars"))
def src_daily_series_json(spark, sf):
    """One payload per instrument and month, so that a payload stays bounded."""
    rows = ticks_bars(spark, sf)
    fields = F.create_map(
        F.lit("1. open"), F.col("open").cast("string"),
        F.lit("4. close"), F.col("close").cast("string"),
        F.lit("5. volume"), F.col("volume").cast("string"))
    per_month = rows.groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), fields)))
        .alias("days"))
    payloads = per_month.select("ticker", F.to_json(
        F.create_map(F.lit("Time Series (Daily)"), F.col("days"))).alias("body"))
    return printable(prices.flatten_daily_series(payloads, "body", ["open", "close", "volume"],
                                                 "ticker"))


@query("src_ohlcv_history", s.twin(
    f"""SELECT {TO_DAY}, open, high, low, close, volume FROM bars
        WHERE ticker = 7 AND date >= DATE '1997-01-01' AND date < DATE '2001-01-01'""", "bars"))
def src_ohlcv_history(spark, sf):
    """Bars of every instrument are written partitioned; the slice is read by pruning."""
    path = new_path(spark, "bars")
    sinks.write_bars(bars(spark, sf), path, shared=True)
    return printable(prices.ohlcv_history(prices.read_bars(spark, path), 7, "1997-01-01",
                                          "2001-01-01")
                     .select(F.col("ticker").cast("long").alias("ticker"), "date", "open",
                             "high", "low", "close", "volume"))


@query("src_multi_ticker", s.twin(
    f"""SELECT {TO_DAY}, close FROM bars WHERE ticker IN (1, 2, 3, 5, 8)
        AND date >= DATE '1996-01-01' AND date < DATE '2020-01-01'""", "bars"))
def src_multi_ticker(spark, sf):
    return printable(prices.multi_ticker(bars(spark, sf), [1, 2, 3, 5, 8], "1996-01-01",
                                         "2020-01-01").select("ticker", "date", "close"))


@query("ohlcv_wide_to_long", s.twin(
    """SELECT CAST(event_type AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
              CAST(max(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS close,
              CAST(count(*) AS DOUBLE) AS volume
       FROM events GROUP BY ALL"""))
def ohlcv_wide_to_long(spark, sf):
    """Per event type and day as `Close_TYPE` columns, then back to one row per pair."""
    events = table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), "event_type", F.round(F.col("value") * 100).cast("long").alias("c"))
    # A wide table has a column per kind, so the kinds are known when it is laid out.
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    wide = events.groupBy("date").agg(*[
        agg for k in kinds for agg in (
            F.max(F.when(F.col("event_type") == k, F.col("c"))).alias(f"Close_{k}"),
            F.nullif(F.count(F.when(F.col("event_type") == k, 1)), F.lit(0)).alias(f"Volume_{k}"))])
    return printable(prices.wide_to_long(wide))


@query("ohlcv_resolve_columns", s.twin(f"SELECT {TO_DAY}, open, high, low, close, volume FROM bars",
                                       "bars"))
def ohlcv_resolve_columns(spark, sf):
    odd = bars(spark, sf).select(
        F.col("date").alias("Trade Date"), F.col("open").alias("OPEN_x"),
        F.col("high").alias("Day High"), F.col("low").alias("lowest"),
        F.col("close").alias("Adj Close"), F.col("volume").alias("Volume_x"), "ticker")
    return printable(prices.resolve_columns(odd, keep=["ticker"]))


@query("src_period_slice", s.twin(
    f"SELECT {TO_DAY}, close FROM ticks_bars WHERE date >= DATE '2024-01-30' - 7", "ticks_bars"))
def src_period_slice(spark, sf):
    return printable(prices.period_slice(ticks_bars(spark, sf), "1w", "2024-01-30")
                     .select("ticker", "date", "close"))


# --- sinks -----------------------------------------------------------------------------------

@query("sink_parquet", s.twin(
    f"SELECT id, {TO_DAY}, title, CAST(label AS BIGINT) AS label, {NAMED} AS label_name FROM a",
    "headlines", "ticks_bars", l=s.labeled("ticks_bars"), a=ALIGNED))
def sink_parquet(spark, sf):
    path = new_path(spark, "dataset")
    rows = ticks_bars(spark, sf)
    dataset = align.align_news_prices(headlines(spark, sf), rows)
    sinks.write_dataset(dataset, path, partition_by="date")
    back = spark.read.parquet(path)
    return printable(back.select("id", "ticker", F.col("date").cast("string").alias("date"),
                                 "title", "label", "label_name"))


@query("sink_csv", s.twin(
    f"SELECT id, title, {NOW} AS published_at FROM headlines", "headlines"))
def sink_csv(spark, sf):
    path = new_path(spark, "export")
    sinks.write_csv(headlines(spark, sf).select("id", "title", _stamp("published_at")
                                                .alias("published_at")), path)
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema("id bigint, title string, published_at string").csv(path))
    return back


@query("sink_vocab", s.twin("SELECT term, df, ctf, round(idf, 6) AS idf FROM vocab",
                            "term_counts", vocab=VOCAB))
def sink_vocab(spark, sf):
    path = new_path(spark, "vocabulary")
    sinks.save_vocabulary(vocabulary.fit_vocabulary(_clean_docs(spark, sf), "clean_text"), path)
    return rounded(sinks.load_vocabulary(spark, path), "idf")


# --- requests and reports --------------------------------------------------------------------

@query("validate_requests",
       "SELECT event_id, length(msg) BETWEEN 5 AND 1000 AS valid FROM ("
       "SELECT doc_id AS event_id, text AS msg FROM documents UNION ALL "
       "SELECT event_id, substring(event_type, 1, CAST(event_id % 7 AS INT)) FROM events)")
def validate_requests(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"),
                                                F.col("text").alias("msg"))
    short = table(spark, sf, "events").select(
        "event_id", F.col("event_type").substr(F.lit(1), (F.col("event_id") % 7).cast("int"))
        .alias("msg"))
    return docs.unionByName(short).select("event_id", tx.valid_headline("msg").alias("valid"))


HISTORY = "SELECT h.*, ts FROM heur h JOIN (SELECT event_id AS id, ts FROM events) USING (id)"


def _history(spark, sf, source=headlines):
    return heuristic.heuristic_score(source(spark, sf)).withColumnRenamed("published_at", "ts")


DISPLAY = f"""SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time,
                CASE WHEN length(title) > 80 THEN substring(title, 1, 80) || '…' ELSE title END
                  AS headline, prediction,
                printf('%.1f%%', {s.decimal_round('greatest(p_down, p_neutral, p_up) * 100', 1)})
                  AS confidence, printf('%.3f', {s.decimal_round('polarity', 3)}) AS polarity,
                'heuristic_fallback, m1' AS model FROM h"""


def _display(spark, sf):
    rows = _history(spark, sf, spread_headlines).withColumnRenamed("title", "headline")
    return printable(reports.display_fields(rows.withColumn(
        "models_used", F.array("model_used", F.lit("m1")))))


@query("display_fields", s.twin(
    """SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END
                AS headline,
              printf('%.1f%%', round(n_chars / 10.0, 1)) AS share FROM documents"""))
def display_fields(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.display_headline("text").alias("headline"),
                       percent(F.col("n_chars") / 1000, 1).alias("share"))


@query("prediction_history", s.twin(DISPLAY, "headlines", **HEUR_VIEWS, h=HISTORY))
def prediction_history(spark, sf):
    path = new_path(spark, "history")
    sinks.append_history(_display(spark, sf), path)
    return reports.latest_first(spark.read.parquet(path), "time")


@query("history_latest_first", s.twin(
    "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, prediction FROM h ORDER BY ts DESC, id DESC",
    "headlines", **HEUR_VIEWS, h=HISTORY))
def history_latest_first(spark, sf):
    return printable(reports.latest_first(_history(spark, sf)).select("id", "ts", "prediction"))


BIN = "CAST(least(floor((polarity + 1) * 10) + 1, 20) AS BIGINT)"


@query("sentiment_histogram", s.twin(
    f"""SELECT {BIN} AS bin, -1.0e0 + ({BIN} - 1) * 2.0e0 / 20 AS low, count(*) AS n
        FROM heur GROUP BY ALL""", "headlines", **HEUR_VIEWS))
def sentiment_histogram(spark, sf):
    return printable(reports.sentiment_histogram(_history(spark, sf)))


TIMELINE_AGG = """count(*) AS n, avg(polarity) AS mean_polarity,
    count(*) FILTER (prediction = 'DOWN') AS n_down,
    count(*) FILTER (prediction = 'NEUTRAL') AS n_neutral,
    count(*) FILTER (prediction = 'UP') AS n_up"""
WINDOWED = (f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
            f"{TIMELINE_AGG} FROM h GROUP BY 1")
KEYED = (f"SELECT ticker, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
         f"{TIMELINE_AGG} FROM (SELECT h.*, user_id AS ticker FROM h JOIN events ON id = event_id) "
         "GROUP BY 1, 2")


@query("sentiment_timeline", s.twin(WINDOWED, "headlines", **HEUR_VIEWS, h=HISTORY))
def sentiment_timeline(spark, sf):
    return printable(reports.sentiment_timeline(_history(spark, sf)))


@query("sentiment_band", s.twin(
    """SELECT id, CASE WHEN polarity < -0.3e0 THEN 'negative' WHEN polarity < 0.3e0 THEN 'neutral'
                       ELSE 'positive' END AS band FROM heur""", "headlines", **HEUR_VIEWS))
def sentiment_band(spark, sf):
    return _history(spark, sf).select("id", lex.sentiment_band("polarity").alias("band"))


# --- streams ---------------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return streams.read_table_stream(spark, sf, "events.parquet", schema)


def _headline_stream(spark, sf):
    return headlines_from(_event_stream(spark, sf), sf)


def _scored_stream(spark, sf):
    scored = streams.stream_score(_headline_stream(spark, sf))
    return scored.withColumn("ts", F.col("published_at").cast("timestamp"))


SCORE_COLUMNS = ["id", "prediction", *P]


@query("stream_score", s.twin(f"SELECT {', '.join(SCORE_COLUMNS)} FROM heur", "headlines",
                              **HEUR_VIEWS))
def stream_score(spark, sf):
    return streams.run_to_table(_scored_stream(spark, sf).select(*SCORE_COLUMNS),
                                new_path(spark, "stream-score"))


CLOSED = KEYED.replace(
    "GROUP BY 1, 2", "WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= "
    "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2")


@query("stream_timeline", s.twin(CLOSED, "headlines", **HEUR_VIEWS, h=HISTORY))
def stream_timeline(spark, sf):
    """The days that the watermark has passed; a day is written once, then its state is freed."""
    timeline = streams.stream_timeline(_scored_stream(spark, sf), every="1 day", keys=["ticker"])
    return printable(streams.run_to_table(timeline, new_path(spark, "stream-timeline")))


@query("stream_label_counts", s.twin(
    "SELECT prediction, count(*) AS n FROM heur GROUP BY ALL", "headlines", **HEUR_VIEWS))
def stream_label_counts(spark, sf):
    counts = streams.stream_label_counts(_scored_stream(spark, sf))
    return streams.run_to_table(counts, new_path(spark, "stream-counts"), streams.write_complete)


@query("stream_align", s.twin(
    f"SELECT id, {TO_DAY}, CAST(label AS BIGINT) AS label FROM a", "headlines", "ticks_bars",
    l=s.labeled("ticks_bars"), a=ALIGNED))
def stream_align(spark, sf):
    joined = streams.stream_align(_headline_stream(spark, sf), ticks_bars(spark, sf))
    return printable(streams.run_to_table(joined.select("id", "ticker", "date", "label"),
                                          new_path(spark, "stream-align")))


@query("stream_align_late", s.twin(
    f"SELECT id, {TO_DAY}, CAST(label AS BIGINT) AS label FROM a", "headlines", "ticks_bars",
    l=s.labeled("ticks_bars"), a=ALIGNED))
def stream_align_late(spark, sf):
    """Headlines and labelled bars both as streams; a bar is known a day after its own."""
    path = new_path(spark, "labeled-bars")
    known = align.labeled_bars(ticks_bars(spark, sf)).select(
        "ticker", "date", "label", F.timestamp_add(
            "DAY", F.lit(1), F.col("date").cast("timestamp")).alias("known_at"))
    known.write.parquet(path)
    labeled = spark.readStream.schema(known.schema).parquet(path)
    joined = streams.stream_align_late(_headline_stream(spark, sf), labeled)
    return printable(streams.run_to_table(joined.select("id", "ticker", "date", "label"),
                                          new_path(spark, "stream-align-late")))


@query("stream_history", s.twin(
    "SELECT id, title AS headline, prediction, polarity, 'heuristic_fallback' AS model_used, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM h", "headlines", **HEUR_VIEWS, h=HISTORY))
def stream_history(spark, sf):
    rows = _scored_stream(spark, sf).select(
        "id", F.col("title").alias("headline"), "prediction", "polarity", "model_used",
        F.col("published_at").alias("ts"))
    return printable(streams.run_to_table(rows, new_path(spark, "stream-history")))


@query("build_dataset", s.twin(
    f"SELECT {NAMED} AS label_name, count(*) AS n FROM a GROUP BY ALL",
    "headlines", "ticks_bars", l=s.labeled("ticks_bars"), a=ALIGNED))
def build(spark, sf):
    dataset = build_dataset(headlines(spark, sf), ticks_bars(spark, sf), tickers=None,
                            start="2020-01-01", end="2030-01-01")
    return dataset.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
