"""Registered queries on bars and news alignment, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions import calendar as cal
from marketlens.operators import align, indicators, metrics
from marketlens.plans import sql as s
from marketlens.plans.tables import bars, headlines, printable, rounded, table, ticks_bars
from marketlens.sources import prices

QUERIES, SQL = {}, {}


def query(key: str, twin: str):
    def register(fn):
        QUERIES[key] = fn
        SQL[key] = twin
        return fn
    return register


W = "OVER (PARTITION BY ticker ORDER BY date)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RET = f"(close / nullif(lag(close) {W}, 0) - 1)"
RETURNS = f"SELECT *, {RET} AS ret FROM bars"
DELTAS = f"SELECT *, close - lag(close) {W} AS delta FROM bars"
PARTS = ("SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain, "
         "CASE WHEN delta IS NOT NULL THEN -least(delta, 0) END AS loss FROM deltas")
RSI = (f"coalesce(100 - 100.0 / (1 + avg(gain) {rows(14)} / nullif(avg(loss) {rows(14)}, 0)), 0)")
TO_DAY = "ticker, CAST(date AS VARCHAR) AS date"


@query("forward_return", s.twin(
    f"SELECT {TO_DAY}, close, forward_return FROM r", "bars", r=s.returns("bars")))
def forward_return(spark, sf):
    out = indicators.forward_return(bars(spark, sf))
    return printable(out.select("ticker", "date", "close", "forward_return"))


@query("label_from_return", s.twin(
    f"SELECT {TO_DAY}, CAST({s.LABEL} AS BIGINT) AS label FROM r", "bars", r=s.returns("bars")))
def label_from_return(spark, sf):
    out = align.with_label(indicators.forward_return(bars(spark, sf)))
    return printable(out.select("ticker", "date", "label"))


@query("label_name", s.twin(
    f"SELECT {TO_DAY}, {s.LABEL_NAME.format('(' + s.LABEL + ')')} AS label_name FROM r",
    "bars", r=s.returns("bars")))
def label_name(spark, sf):
    out = align.with_label(indicators.forward_return(bars(spark, sf)))
    return printable(out.select("ticker", "date", "label_name"))


@query("filter_labeled", s.twin(
    f"SELECT {TO_DAY}, forward_return, CAST(label AS BIGINT) AS label FROM l",
    "bars", l=s.labeled("bars")))
def filter_labeled(spark, sf):
    out = align.labeled_bars(bars(spark, sf))
    return printable(out.select("ticker", "date", "forward_return", "label"))


@query("moving_averages", s.twin(
    f"SELECT {TO_DAY}, " + ", ".join(f"avg(close) {rows(n)} AS ma_{n}"
                                     for n in params.MA_WINDOWS) + " FROM bars", "bars"))
def moving_averages(spark, sf):
    out = indicators.moving_averages(bars(spark, sf))
    return printable(out.select("ticker", "date", *[f"ma_{n}" for n in params.MA_WINDOWS]))


@query("ma_ratios", s.twin(
    f"SELECT {TO_DAY}, " + ", ".join(f"close / nullif(avg(close) {rows(n)}, 0) AS ma_ratio_{n}"
                                     for n in params.MA_WINDOWS) + " FROM bars", "bars"))
def ma_ratios(spark, sf):
    out = indicators.ma_ratios(bars(spark, sf))
    return printable(out.select("ticker", "date", *[f"ma_ratio_{n}" for n in params.MA_WINDOWS]))


@query("pct_change", s.twin(f"SELECT {TO_DAY}, {RET} AS pct_change FROM bars", "bars"))
def pct_change(spark, sf):
    return printable(indicators.pct_change(bars(spark, sf)).select("ticker", "date", "pct_change"))


@query("volatility", s.twin(
    f"SELECT {TO_DAY}, round(coalesce(stddev_samp(ret) {rows(20)}, 0), 6) AS volatility FROM r",
    "bars", r=RETURNS))
def volatility(spark, sf):
    out = indicators.volatility(bars(spark, sf))
    return printable(rounded(out.select("ticker", "date", "volatility"), "volatility"))


@query("momentum", s.twin(
    f"SELECT {TO_DAY}, close / nullif(lag(close, 14) {W}, 0) - 1 AS momentum FROM bars", "bars"))
def momentum(spark, sf):
    return printable(indicators.momentum(bars(spark, sf)).select("ticker", "date", "momentum"))


@query("volume_ma", s.twin(f"SELECT {TO_DAY}, avg(volume) {rows(20)} AS volume_ma FROM bars",
                           "bars"))
def volume_ma(spark, sf):
    return printable(indicators.volume_features(bars(spark, sf))
                     .select("ticker", "date", "volume_ma"))


@query("volume_ratio", s.twin(
    f"SELECT {TO_DAY}, avg(volume) {rows(20)} AS volume_ma, "
    f"coalesce(volume / nullif(avg(volume) {rows(20)}, 0), 0) AS volume_ratio FROM bars", "bars"))
def volume_ratio(spark, sf):
    out = indicators.volume_features(bars(spark, sf))
    return printable(out.select("ticker", "date", "volume_ma", "volume_ratio"))


@query("price_delta", s.twin(
    f"SELECT {TO_DAY}, delta, gain, loss FROM p", "bars", deltas=DELTAS, p=PARTS))
def price_delta(spark, sf):
    out = indicators.price_delta(bars(spark, sf))
    return printable(out.select("ticker", "date", "delta", "gain", "loss"))


@query("rsi", s.twin(f"SELECT {TO_DAY}, {RSI} AS rsi FROM p", "bars", deltas=DELTAS, p=PARTS))
def rsi(spark, sf):
    return printable(indicators.rsi(bars(spark, sf)).select("ticker", "date", "rsi"))


@query("chart_overlays", s.twin(
    f"SELECT {TO_DAY}, open, high, low, close, volume, avg(close) {rows(20)} AS ma_20, "
    f"avg(close) {rows(50)} AS ma_50 FROM bars", "bars"))
def chart_overlays(spark, sf):
    return printable(indicators.chart_overlays(bars(spark, sf)).select(
        "ticker", "date", "open", "high", "low", "close", "volume", "ma_20", "ma_50"))


def _market_sql() -> str:
    columns = []
    for n in params.MA_WINDOWS:
        columns.append(f"coalesce(avg(close) {rows(n)}, 0) AS ma_{n}")
        columns.append(f"coalesce(close / nullif(avg(close) {rows(n)}, 0), 0) AS ma_ratio_{n}")
    columns += [
        f"round(coalesce(stddev_samp(ret) {rows(20)}, 0), 6) AS volatility",
        f"coalesce(close / nullif(lag(close, 14) {W}, 0) - 1, 0) AS momentum",
        f"avg(volume) {rows(20)} AS volume_ma",
        f"coalesce(volume / nullif(avg(volume) {rows(20)}, 0), 0) AS volume_ratio",
        f"{RSI} AS rsi"]
    return s.twin(f"SELECT {TO_DAY}, {', '.join(columns)} FROM p", "bars",
                  deltas=f"SELECT *, close - lag(close) {W} AS delta FROM (SELECT *, "
                         f"{RET} AS ret FROM bars)", p=PARTS)


@query("market_features", _market_sql())
def market_features(spark, sf):
    out = indicators.market_features(bars(spark, sf))
    out = rounded(out, "volatility")
    return printable(out.select("ticker", "date", *indicators.MARKET_FEATURES))


@query("fill_zero", s.twin(
    f"SELECT {TO_DAY}, coalesce(CAST(close / nullif(lag(close, 14) {W}, 0) - 1 AS DOUBLE), 0.0) "
    f"AS momentum, coalesce(CAST({RET} AS DOUBLE), 0.0) AS pct_change FROM bars", "bars"))
def fill_zero(spark, sf):
    out = indicators.pct_change(indicators.momentum(bars(spark, sf)))
    return printable(align.fill_all(out, ["momentum", "pct_change"])
                     .select("ticker", "date", "momentum", "pct_change"))


@query("sort_by_date", s.twin(
    f"SELECT {TO_DAY}, close FROM bars ORDER BY ticker, date", "bars"))
def sort_by_date(spark, sf):
    return printable(prices.sort_by_date(bars(spark, sf)).select("ticker", "date", "close"))


# --- alignment -----------------------------------------------------------------------------

ALIGNED = ("SELECT h.id, h.ticker, h.title, l.date, l.forward_return, l.label "
           "FROM headlines h JOIN l ON h.ticker = l.ticker AND CAST(h.published_at AS DATE) = l.date")
NAMED = s.LABEL_NAME.format("label")


@query("align_news_prices", s.twin(
    f"SELECT id, {TO_DAY}, title, forward_return, CAST(label AS BIGINT) AS label, "
    f"{NAMED} AS label_name FROM a", "headlines", "ticks_bars", l=s.labeled("ticks_bars"),
    a=ALIGNED))
def align_news_prices(spark, sf):
    out = align.align_news_prices(headlines(spark, sf), ticks_bars(spark, sf))
    return printable(out.select("id", "ticker", "date", "title", "forward_return", "label",
                                "label_name"))


@query("align_untagged_news", s.twin(
    f"SELECT {TO_DAY}, CAST(label AS BIGINT) AS label, count(*) AS n_news FROM ("
    "SELECT l.ticker, l.date, l.label FROM headlines h JOIN l "
    "ON CAST(h.published_at AS DATE) = l.date) GROUP BY ticker, date, label",
    "headlines", "ticks_bars", l=s.labeled("ticks_bars")))
def align_untagged_news(spark, sf):
    out = align.align_untagged_counts(headlines(spark, sf), ticks_bars(spark, sf))
    return printable(out.select("ticker", "date", "label", "n_news"))


@query("label_distribution", s.twin(
    f"SELECT {NAMED} AS label_name, count(*) AS n FROM a GROUP BY ALL",
    "headlines", "ticks_bars", l=s.labeled("ticks_bars"), a=ALIGNED))
def label_distribution(spark, sf):
    return metrics.label_distribution(
        align.align_news_prices(headlines(spark, sf), ticks_bars(spark, sf)))


@query("class_weights", s.twin(
    "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, "
    "(SELECT count(*) FROM l) / ((SELECT count(DISTINCT label) FROM l) * count(*)) AS weight "
    "FROM l GROUP BY label", "bars", l=s.labeled("bars")))
def class_weights(spark, sf):
    return printable(metrics.class_weights(align.labeled_bars(bars(spark, sf))))


@query("weight_join", s.twin(
    f"SELECT {TO_DAY}, CAST(l.label AS BIGINT) AS label, weight FROM l JOIN w USING (label)",
    "bars", l=s.labeled("bars"),
    w="SELECT label, (SELECT count(*) FROM l) / ((SELECT count(DISTINCT label) FROM l) * "
      "count(*)) AS weight FROM l GROUP BY label"))
def weight_join(spark, sf):
    labeled = align.labeled_bars(bars(spark, sf))
    out = align.weight_join(labeled, metrics.class_weights(labeled))
    return printable(out.select("ticker", "date", "label", "weight"))


@query("filter_ticker", s.twin(
    "SELECT id, ticker, title FROM headlines WHERE ticker IN (3, 5, 8)", "headlines"))
def filter_ticker(spark, sf):
    return align.filter_ticker(headlines(spark, sf), [3, 5, 8]).select("id", "ticker", "title")


@query("norm_date_key", """
    SELECT id, CAST(try_cast(raw AS DATE) AS VARCHAR) AS merge_date
    FROM (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raw FROM events
          UNION ALL SELECT event_id, 'n/a' FROM events WHERE event_id % 7 = 0)""")
def norm_date_key(spark, sf):
    raw = _raw_times(table(spark, sf, "events"))
    return printable(raw.select("id", cal.date_key(cal.parse_lenient("raw")).alias("merge_date")))


def _raw_times(events):
    """Time strings as a feed would deliver them, with unparsable ones beside them."""
    good = events.select(F.col("event_id").alias("id"),
                         F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw"))
    return good.union(events.where("event_id % 7 = 0").select("event_id", F.lit("n/a")))


@query("parse_datetime_lenient", """
    SELECT id, strftime(try_cast(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published_at
    FROM (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raw FROM events
          UNION ALL SELECT event_id, 'n/a' FROM events WHERE event_id % 7 = 0)""")
def parse_datetime_lenient(spark, sf):
    raw = _raw_times(table(spark, sf, "events"))
    return printable(raw.select("id", cal.parse_lenient("raw").alias("published_at")))


@query("parse_epoch", """
    SELECT event_id AS id, strftime(TIMESTAMP '1970-01-01' +
             to_seconds(epoch(date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS published_at
    FROM events""")
def parse_epoch(spark, sf):
    events = table(spark, sf, "events").withColumn("seconds", cal.epoch_seconds("ts"))
    return printable(events.select(F.col("event_id").alias("id"),
                                   cal.parse_epoch("seconds").alias("published_at")))


TIMES = "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events"


def _times(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))


SESSION = "CAST(CASE WHEN hour(ts) >= 16 THEN 2 WHEN hour(ts) >= 9 THEN 1 ELSE 0 END AS BIGINT)"
DOW = "(isodow(ts) - 1)"
CALENDAR = (f"coalesce(hour(ts), 0) AS hour, coalesce({DOW}, 0) AS day_of_week, "
            f"CAST(coalesce(CASE WHEN {DOW} >= 5 THEN 1 ELSE 0 END, 0) AS BIGINT) AS is_weekend")
WAVES = ", ".join(
    f"round(coalesce({fn}(2 * pi() * {x} / {n}), 0), 6) + 0.0 AS {name}_{fn}"
    for name, x, n in (("hour", "hour(ts)", 24), ("dow", DOW, 7)) for fn in ("sin", "cos"))


@query("calendar_features", s.twin(f"SELECT id, {CALENDAR} FROM t", t=TIMES))
def calendar_features(spark, sf):
    names = cal.TEMPORAL_FEATURES[:3]
    return printable(_times(spark, sf).select("id", *cal.temporal_features("ts"))
                     .select("id", *names))


@query("market_session", s.twin(f"SELECT id, {SESSION} AS market_session FROM t", t=TIMES))
def market_session(spark, sf):
    return printable(_times(spark, sf).select("id", cal.market_session("ts")
                                              .alias("market_session")))


@query("cyclical_time", s.twin(f"SELECT id, {WAVES} FROM t", t=TIMES))
def cyclical_time(spark, sf):
    names = cal.TEMPORAL_FEATURES[4:]
    out = _times(spark, sf).select("id", *cal.temporal_features("ts")).select("id", *names)
    return printable(rounded(out, *names))


@query("temporal_features", s.twin(
    f"SELECT id, {CALENDAR}, {SESSION} AS market_session, {WAVES} FROM t", t=TIMES))
def temporal_features(spark, sf):
    out = _times(spark, sf).select("id", *cal.temporal_features("ts"))
    return printable(rounded(out, *cal.TEMPORAL_FEATURES[4:]))
