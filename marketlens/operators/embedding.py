"""Text embeddings: a hashed bag of tokens in SQL, or any model through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import params
from marketlens.functions.text import null_text_to_empty, split_words
from marketlens.functions.vectors import sparse_vector


def hashed_counts(df: DataFrame, text: str, output: str,
                  dim: int = params.EMBEDDING_DIM) -> DataFrame:
    """Append array<struct<bucket, n>>, ascending: tokens counted in `dim` buckets by md5.

    Only the sorted bucket numbers are counted, not the words; nothing leaves the row.
    """
    given = [c for c in df.columns if c != output]
    buckets = F.transform(split_words(F.lower(null_text_to_empty(text))), lambda w: (
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    ordered = df.select(*given, F.sort_array(buckets).alias("_b"))
    ends = ordered.withColumn("_ends", F.array_compact(F.transform(
        "_b", lambda b, i: F.when(~F.get("_b", i + 1).eqNullSafe(b), i))))
    return ends.select(*given, F.transform("_ends", lambda end, i: F.struct(
        F.get("_b", end).alias("bucket"),
        (end - F.coalesce(F.get("_ends", i - 1), F.lit(-1))).cast("long").alias("n")))
        .alias(output))


def _unit_weights(counts: str) -> Column:
    """array<struct<bucket, weight>>: counts divided by their Euclidean length. The length is
    bound to the row first, so that it is computed once and not for every entry."""
    counted = F.col(counts)
    square = F.aggregate(counted, F.lit(0).cast("long"), lambda s, b: s + b["n"] * b["n"])
    bound = F.array(F.struct(counted.alias("b"), F.sqrt(square).alias("norm")))
    return F.transform(bound, lambda row: F.transform(row["b"], lambda b: F.struct(
        b["bucket"].alias("bucket"), (b["n"] / row["norm"]).alias("weight"))))[0]


def hashed_buckets(df: DataFrame, text: str, row_id: str,
                   dim: int = params.EMBEDDING_DIM) -> DataFrame:
    """Long form (row_id, bucket, weight) of the bucket counts at unit length."""
    counted = hashed_counts(df.select(row_id, text), text, "_b", dim)
    return counted.select(row_id, F.inline(_unit_weights("_b")))


def hashed_embedding(df: DataFrame, text: str, dim: int = params.EMBEDDING_DIM,
                     output: str = "embedding") -> DataFrame:
    """Append one dense array<float> per row, of unit length; zeros for empty text."""
    counted = hashed_counts(df, text, "_b", dim).withColumn("_b", _unit_weights("_b"))
    scaled = counted.withColumn("_v", sparse_vector(
        F.col("_b.bucket"), F.col("_b.weight"), dim))
    return scaled.withColumn(output, vector_to_array("_v", "float32")).drop("_b", "_v")


def model_embedding(df: DataFrame, text: str, make_predict: Callable,
                    batch_size: int = 64) -> DataFrame:
    """Embed with a user-supplied model: `make_predict` loads it once per Python worker and
    returns a function from a batch of strings to a (batch, dim) array."""
    embed = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()),
                              batch_size=batch_size)
    return df.withColumn("embedding", embed(null_text_to_empty(text)))
