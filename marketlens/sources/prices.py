"""Price readers, payload flattening and layout normalisation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import params, schemas
from marketlens.functions.calendar import parse_epoch
from marketlens.operators.align import concat_frames
from marketlens.sources.sinks import BAR_FOLDER, bar_folder


def flatten_quote(payloads: DataFrame, payload: Column | str, *keep: str) -> DataFrame:
    """Quote snapshot `{c, h, l, o, pc, t}`; missing prices stay null, missing time is 0."""
    q = payloads.select(*keep, F.from_json(payload, schemas.QUOTE_PAYLOAD).alias("_q"))
    names = {"c": "current", "h": "high", "l": "low", "o": "open", "pc": "prev_close"}
    return q.select(
        *keep, *[F.col(f"_q.{k}").alias(v) for k, v in names.items()],
        parse_epoch(F.coalesce(F.col("_q.t"), F.lit(0))).alias("timestamp"))


def flatten_market_quote(payloads: DataFrame, payload: Column | str, *keep: str) -> DataFrame:
    """Snapshot with market price, change, percent change and volume; missing is null."""
    q = payloads.select(*keep, F.from_json(payload, schemas.MARKET_QUOTE_PAYLOAD).alias("_q"))
    names = {"regularMarketPrice": "price", "regularMarketChange": "change",
             "regularMarketChangePercent": "change_pct", "regularMarketVolume": "volume"}
    return q.select(*keep, *[F.col(f"_q.{k}").alias(v) for k, v in names.items()])


def flatten_daily_series(payloads: DataFrame, payload: Column | str, fields: Iterable[str],
                         *keep: str, root: str = "Time Series (Daily)") -> DataFrame:
    """Map of date -> map of "N. field" -> number string, to one row per date."""
    series = F.from_json(payload, schemas.DAILY_SERIES_PAYLOAD)[root]
    days = payloads.select(*keep, F.explode(series).alias("_date", "_fields"))
    clean = F.transform_keys("_fields", lambda k, _: F.regexp_replace(k, r"^.*?\. ", ""))
    named = days.select(*keep, F.to_date("_date").alias("date"), clean.alias("_f"))
    return named.select(*keep, "date", *[
        F.try_element_at("_f", F.lit(f)).try_cast("double").alias(f.replace(" ", "_"))
        for f in fields])


def ohlcv_history(bars: DataFrame, ticker, start: str = "2020-01-01",
                  end: str | None = None) -> DataFrame:
    """One instrument's bars in [start, end); both predicates reach the file scan, and folders
    shared by instruments are pruned."""
    end = end or dt.date.today().isoformat()
    day = F.col("date")
    if BAR_FOLDER in bars.columns:
        bars = bars.where(F.col(BAR_FOLDER) == bar_folder(F.lit(ticker))).drop(BAR_FOLDER)
    return bars.where((F.col("ticker") == ticker) & (day >= F.lit(start).cast("date"))
                      & (day < F.lit(end).cast("date")))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars written by `sinks.write_bars` (partitioned for pruning)."""
    return spark.read.parquet(path)


def read_bars_csv(spark: SparkSession, path: str | list[str],
                  schema: str = schemas.BAR_SCHEMA) -> DataFrame:
    """Long price history from CSV with a fixed schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def multi_ticker(bars: DataFrame, tickers: Iterable | None = params.DEFAULT_TICKERS,
                 start: str = "2020-01-01", end: str | None = None) -> DataFrame:
    """Several instruments (all of them for None) in one scan instead of one read each."""
    end = end or dt.date.today().isoformat()
    dated = bars.where((F.col("date") >= F.lit(start).cast("date"))
                       & (F.col("date") < F.lit(end).cast("date")))
    return dated if tickers is None else dated.where(F.col("ticker").isin(list(tickers)))


def tagged_union(frames: dict) -> DataFrame:
    """Concatenate per-instrument tables, tagging each with its instrument."""
    return concat_frames(*[df.withColumn("ticker", F.lit(t)) for t, df in frames.items()])


# Bar fields looked up by substring.
BAR_FIELDS = ("date", "open", "high", "low", "close", "volume")


def resolve_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Find bar columns by case-insensitive substring, first match wins; close is required.

    `keep` names further columns to carry along unchanged.
    """
    keep = list(keep)
    found = {}
    for field in BAR_FIELDS:
        match = next((c for c in df.columns if c not in keep and field in c.lower()), None)
        if match is not None:
            found[field] = match
    if "close" not in found:
        raise KeyError("no close price column")
    found.setdefault("date", df.columns[0])
    return df.select(*keep, *[F.col(f"`{c}`").alias(f) for f, c in found.items()])


def wide_to_long(df: DataFrame, date: str = "date") -> DataFrame:
    """`Field_TICKER` columns to one row per (ticker, date).

    The set of fields and tickers is in the column names, so each ticker becomes one struct
    of an array and the array is inlined: no shuffle, unlike unpivot and pivot.
    """
    tickers: dict[str, dict[str, str]] = {}
    for column in df.columns:
        field, _, ticker = column.partition("_")
        if ticker and column != date:
            tickers.setdefault(ticker, {})[field.lower()] = column
    fields = sorted({f for columns in tickers.values() for f in columns})
    rows = F.array(*[
        F.struct(F.lit(ticker).alias("ticker"), *[
            (F.col(f"`{columns[f]}`") if f in columns else F.lit(None)).cast("double").alias(f)
            for f in fields])
        for ticker, columns in tickers.items()])
    long = df.select(date, F.inline(rows))
    present = F.coalesce(*[F.col(f) for f in fields]).isNotNull()
    return long.where(present)


def period_days(code: str, periods: dict[str, int] = params.PERIOD_DAYS) -> int:
    return periods.get(code, params.DEFAULT_PERIOD_DAYS)


def period_slice(bars: DataFrame, code: str, asof: str | dt.date,
                 periods: dict[str, int] = params.PERIOD_DAYS) -> DataFrame:
    """Bars from `asof` minus the period on; the bound is a literal, so it is pushed down."""
    day = dt.date.fromisoformat(asof) if isinstance(asof, str) else asof
    bound = day - dt.timedelta(days=period_days(code, periods))
    return bars.where(F.col("date") >= F.lit(bound))


def sort_by_date(bars: DataFrame) -> DataFrame:
    return bars.orderBy("ticker", "date")
