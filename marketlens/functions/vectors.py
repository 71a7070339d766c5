"""Sparse vectors inside the row, without Python on the executors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOLDER = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """Vector from an ascending index array and the array of values there.

    Spark has no constructor for sparse vectors in SQL, but its JSON reader can read any type,
    and doubles survive their own spelling exactly.
    """
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     indices.cast("array<int>").alias("indices"),
                     values.cast("array<double>").alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _HOLDER)["v"]


def sparse_parts(vector: Column | str) -> tuple[Column, Column]:
    """(indices, values) of a sparse vector."""
    parts = F.unwrap_udt(vector)
    return parts["indices"], parts["values"]


def add_run_lengths(df: DataFrame, values: str, output: str) -> DataFrame:
    """Append array<struct<value, n>>: the distinct entries of an array, ascending, and how
    often each stands there."""
    given = [c for c in df.columns if c != output]
    ordered = df.select(*given, F.sort_array(values).alias("_sorted"))
    ends = ordered.select(*given, F.array_compact(F.transform(
        "_sorted", lambda v, i: F.when(
            ~F.get("_sorted", i + 1).eqNullSafe(v),
            F.struct(v.alias("value"), (i + 1).alias("seen"))))).alias("_ends"))
    return ends.select(*given, F.transform("_ends", lambda end, i: F.struct(
        end["value"].alias("value"),
        (end["seen"] - F.coalesce(F.get("_ends", i - 1)["seen"], F.lit(0))).cast("long")
        .alias("n"))).alias(output))
