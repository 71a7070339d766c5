"""Feature scaling with population statistics, and padding of missing features."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) with the population standard deviation, in one aggregation."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                    for c in features])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"),
                 F.col(c)["std"].alias("std")) for c in features])))


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """(position, mean, std) of an array column, for arrays of any length."""
    return (df.select(F.posexplode(vector).alias("position", "x")).groupBy("position")
            .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))


def _stats_struct(train: DataFrame, features: list[str]) -> Column:
    """One-row statistics as a scalar subquery, so no join is planned."""
    return train.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
        for c in features]).alias("stats")).scalar()


def standardise(df: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / std with statistics of `train`; constant columns become 0."""
    stats = df.withColumn("_stats", _stats_struct(train, features))
    scaled = {}
    for c in features:
        mean, std = F.col(f"_stats.{c}.mean"), F.col(f"_stats.{c}.std")
        scaled[c] = F.when(std == 0, F.lit(0.0)).otherwise((F.col(c) - mean) / std)
    return stats.withColumns(scaled).drop("_stats")


def pad_missing_features(df: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Fill null or absent features with the training mean, matched by name."""
    present = df.withColumn("_stats", _stats_struct(train, features))
    return present.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_stats.{c}.mean")) if c in df.columns
        else F.col(f"_stats.{c}.mean") for c in features}).drop("_stats")


def fit_vector_scaler(train: DataFrame, vector: str = "features",
                      output: str = "scaled", center: bool = True) -> PipelineModel:
    """Standard scaler on a vector column, corrected from sample to population std.

    Centering makes sparse vectors dense; pass `center=False` for wide term vectors.
    """
    n = train.count()
    size = len(train.select(vector).first()[0])
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    stages = [
        StandardScaler(inputCol=vector, outputCol=f"_{output}", withMean=center, withStd=True),
        ElementwiseProduct(inputCol=f"_{output}", outputCol=output,
                           scalingVec=Vectors.dense([factor] * size))]
    return Pipeline(stages=stages).fit(train)
