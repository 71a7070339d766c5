"""Writers for datasets, histories, models and vocabularies."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, partition_by: str | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet, optionally partitioned. The rebalance hint lets AQE merge small output
    partitions and split a hot one, so no single task writes a whole hot day."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


#: Folders of `write_bars` with `shared`, and the column that they are named after.
BAR_FOLDERS, BAR_FOLDER = 64, "ticker_folder"


def bar_folder(ticker: Column) -> Column:
    """Folder of an instrument, the same for a number of any width and its text."""
    return F.pmod(F.crc32(ticker.cast("string").cast("binary")), F.lit(BAR_FOLDERS)).cast("int")


def write_bars(bars: DataFrame, path: str, shared: bool = False) -> None:
    """One folder per instrument, for a few thousand at most: each costs a file, a move by the
    committing driver and a listing. With `shared` instruments are dealt by hash over a fixed
    number of folders, sorted inside them, so that a file's statistics tell where one is."""
    if shared:
        (bars.withColumn(BAR_FOLDER, bar_folder(F.col("ticker"))).hint("rebalance", BAR_FOLDER)
         .sortWithinPartitions(BAR_FOLDER, "ticker", "date")
         .write.mode("overwrite").partitionBy(BAR_FOLDER).parquet(path))
    else:
        write_dataset(bars, path, "ticker")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Model with its scaler and feature stages, as one directory."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Fitted terms and weights: at most the vocabulary cap, so one file."""
    vocabulary.select("term", "df", "ctf", "idf").coalesce(1).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("idf", F.col("idf").cast("double"))
