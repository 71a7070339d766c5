"""Live scoring as Structured Streaming: the batch expressions on unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.lexicons import DEFAULT_LEXICON, Lexicon
from marketlens.operators.align import labeled_bars
from marketlens.functions.calendar import dated
from marketlens.operators.heuristic import heuristic_score
from marketlens.operators.reports import sentiment_timeline


def read_table_stream(spark: SparkSession, folder: str, file_name: str, schema,
                      files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_score(headlines: DataFrame, text: str = "title",
                 lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Stateless scoring; any `PipelineModel.transform` composes the same way."""
    return heuristic_score(headlines, text, lexicon)


def stream_timeline(scored: DataFrame, time: str = "ts", every: str = "1 hour",
                    watermark: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Windowed mean polarity per key; the watermark bounds the state in append and update."""
    return sentiment_timeline(scored.withWatermark(time, watermark), time, every, keys)


def stream_label_counts(scored: DataFrame) -> DataFrame:
    """Running class counts; the state is one row per class."""
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def stream_align(headlines: DataFrame, bars: DataFrame, close: str = "close",
                 time: str = "published_at") -> DataFrame:
    """Stream-static equi-join of live headlines with labeled bars; no state."""
    stamped = dated(headlines, time).where(F.col("date").isNotNull())
    return stamped.join(labeled_bars(bars, close), ["ticker", "date"], "inner")


def stream_align_late(headlines: DataFrame, labeled: DataFrame, time: str = "published_at",
                      known: str = "known_at", wait: str = "7 days",
                      lateness: str = "1 day") -> DataFrame:
    """Stream-stream join of headlines with labelled bars that come later.

    `labeled` has ticker, date, label and the time at which the bar was known. A headline waits
    for its bar up to `wait` after it was published; both sides may be `lateness` behind their
    stream's newest row. State older than that is freed.
    """
    stamped = dated(headlines, time).where(F.col("date").isNotNull()).withColumn(
        "_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    bars = labeled.select(F.col("ticker").alias("_ticker"), F.col("date").alias("_date"), "label",
                          known).withWatermark(known, lateness)
    return stamped.join(bars, (F.col("ticker") == F.col("_ticker"))
                        & (F.col("date") == F.col("_date"))
                        & (F.col(known) >= F.col("_at") - F.expr("INTERVAL 1 DAY"))
                        & (F.col(known) <= F.col("_at") + F.expr(f"INTERVAL {wait}")),
                        "inner").drop("_ticker", "_date", "_at")


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet append of everything available, then stop."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_complete(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep `path` equal to the full aggregate; a replayed batch rewrites the same table."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (stream.writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, path: str,
                 writer: Callable[[DataFrame, str, str], StreamingQuery] = write_append
                 ) -> DataFrame:
    """Drain the available input into `path` and read it back."""
    spark = stream.sparkSession
    writer(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path)
