"""Running sums and ranks over long ordered groups without one task per group.

A window over a whole class, score list or price series would put a hot group in one task.
Here each group is cut into ordered buckets: bucket totals are aggregated map-side, their
running offsets are computed on the small totals table, and the row-level window only spans
one bucket. The result equals the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # default hex digits of an md5 bucket: 4096 buckets per group


def hash_key(*parts: Column | str, seed: int | str) -> Column:
    """Deterministic md5 order key of a row identity."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(key: Column | str, digits: int = HASH_DIGITS) -> Column:
    return F.substring(key, 1, digits)


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str,
                   sums: dict[str, Column]) -> DataFrame:
    """Per (keys, bucket): the total of each sum and its exclusive running total."""
    totals = df.groupBy(*keys, bucket).agg(*[c.alias(n) for n, c in sums.items()])
    before = (Window.partitionBy(*keys).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(
        *keys, bucket, *sums,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])


def with_offsets(df: DataFrame, offsets: DataFrame, names: list[str],
                 values: list[str]) -> DataFrame:
    """Attach offset columns; keys compare null-safe so that no row is lost."""
    side = offsets.select(*[F.col(n).alias(f"_k_{n}") for n in names], *values)
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_k_{n}"))
    return df.join(side, condition, "left").drop(*[f"_k_{n}" for n in names])


def running_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str],
                 name: str = "rank") -> DataFrame:
    """`row_number` within keys for rows ordered by (bucket, order)."""
    offsets = bucket_offsets(df, keys, bucket, {"_n": F.count(F.lit(1))})
    joined = with_offsets(df, offsets, [*keys, bucket], ["_n_before"])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (joined.withColumn(name, F.row_number().over(inside) + F.col("_n_before"))
            .drop("_n_before"))


def running_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str],
                 values: dict[str, str]) -> DataFrame:
    """Inclusive running sums {output: input} within keys, rows ordered by (bucket, order)."""
    sums = {f"_s_{out}": F.sum(src) for out, src in values.items()}
    offsets = bucket_offsets(df, keys, bucket, sums)
    joined = with_offsets(df, offsets, [*keys, bucket], [f"{n}_before" for n in sums])
    inside = (Window.partitionBy(*keys, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    for out, src in values.items():
        joined = joined.withColumn(out, F.sum(src).over(inside) + F.col(f"_s_{out}_before"))
    return joined.drop(*[f"{n}_before" for n in sums])


def running_last(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str],
                 value: str, name: str) -> DataFrame:
    """Last non-null value so far within keys, rows ordered by (bucket, order)."""
    rank = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, bucket).agg(F.max_by(value, rank).alias("_last"))
    before = (Window.partitionBy(*keys).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, bucket,
                          F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = with_offsets(df, carried, [*keys, bucket], ["_carried"])
    inside = (Window.partitionBy(*keys, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, F.coalesce(
        F.last(value, ignorenulls=True).over(inside), F.col("_carried"))).drop("_carried")
