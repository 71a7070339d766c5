"""Report tables: history, histogram, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.labels import percent
from marketlens.functions.text import display_headline


def display_fields(history: DataFrame, row_id: str = "id") -> DataFrame:
    """Table view of prediction records; `models_used` may be an array or a name."""
    models = F.col("models_used")
    if dict(history.dtypes)["models_used"].startswith("array"):
        models = F.concat_ws(", ", models)
    return history.select(
        row_id, F.col("ts").alias("time"), display_headline("headline").alias("headline"),
        "prediction", percent("confidence", 1).alias("confidence"),
        F.format_string("%.3f", F.round("polarity", 3)).alias("polarity"),
        models.alias("model"))


def latest_first(history: DataFrame, time: str = "ts", row_id: str = "id") -> DataFrame:
    """Newest first: a range-partitioned sort, no single-task step."""
    return history.orderBy(F.col(time).desc(), F.col(row_id).desc())


def prediction_history(scored: DataFrame, time: str = "ts") -> DataFrame:
    """Stamp scored records for the append-only history."""
    return scored if time in scored.columns else scored.withColumn(time, F.current_timestamp())


def sentiment_histogram(scored: DataFrame, polarity: str = "polarity",
                        bins: int = params.HISTOGRAM_BINS) -> DataFrame:
    """Counts of polarity in `bins` equal bins over [-1, 1]; empty for fewer than 2 records."""
    bucket = F.least(F.width_bucket(F.col(polarity), F.lit(-1.0), F.lit(1.0), F.lit(bins)),
                     F.lit(bins))
    counts = (scored.where(F.col(polarity).isNotNull())
              .groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most `bins` rows
    return (counts.withColumn("_total", total).where(F.col("_total") > 1)
            .select("bin", (F.lit(-1.0) + (F.col("bin") - 1) * F.lit(2.0) / bins)
                    .alias("low"), "n"))


def sentiment_timeline(scored: DataFrame, time: str = "ts", every: str = "1 hour",
                       keys: list[str] | None = None) -> DataFrame:
    """Mean polarity and class counts per time window (and key), pre-aggregated map-side."""
    window = F.window(time, every)
    return (scored.groupBy(*(keys or []), window.alias("_w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("polarity").alias("mean_polarity"),
                 *[F.count(F.when(F.col("prediction") == name, 1)).alias(f"n_{name.lower()}")
                   for name in params.LABEL_NAMES.values()])
            .select(*(keys or []), F.col("_w.start").alias("window_start"), "n",
                    "mean_polarity", *[f"n_{n.lower()}" for n in params.LABEL_NAMES.values()]))
