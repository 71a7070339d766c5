"""Seeded stratified splits, folds and samples, ordered by md5 of the row identity.

The split depends only on (seed, id), so a retried or re-planned task reproduces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens import params
from marketlens.operators.running import (
    HASH_DIGITS, bucket_offsets, hash_bucket, hash_key, running_rank, with_offsets)


def class_quotas(counts: DataFrame, label: str, share: float) -> DataFrame:
    """Test rows per class: floor of n_c * share, plus one by largest remainder.

    `counts(label, _n)` holds one row per class.
    """
    whole = Window.partitionBy(F.lit(0))
    # Rounding hides binary noise such as 35 * 0.2 = 7.000000000000001.
    exact = F.round(F.col("_n") * F.lit(float(share)), 6)
    target = F.ceil(F.round(F.sum("_n").over(whole) * F.lit(float(share)), 6))
    parts = counts.select(label, F.floor(exact).alias("_base"),
                          F.round(exact - F.floor(exact), 6).alias("_rest"),
                          target.alias("_target"))
    spare = F.col("_target") - F.sum("_base").over(whole)
    turn = F.row_number().over(whole.orderBy(F.col("_rest").desc(), label))
    return parts.select(
        label, (F.col("_base") + F.when(turn <= spare, 1).otherwise(0)).alias("_quota"))


def test_share(test_size: int | float, n_rows: int) -> float:
    """A row count becomes a share; a count not below the table size falls back to 0.2."""
    if isinstance(test_size, int):
        return test_size / n_rows if test_size < n_rows else params.TEST_SHARE
    return test_size


def stratified_split(df: DataFrame, label: str, row_id: str, share: float = params.TEST_SHARE,
                     seed: int = params.SEED, digits: int = HASH_DIGITS) -> DataFrame:
    """Add boolean `is_test`: per class, the rows with the smallest keys up to the quota.

    A null label is a class of its own. The class's last test row is found first: hash buckets
    are counted, and only the one bucket that contains the boundary is ranked, so no class is
    sorted in one task. The split itself then compares keys, one pass without a shuffle of its
    own when the few last rows are small enough to broadcast.
    """
    key = hash_key(row_id, seed=seed)
    place = df.select(F.col(label), key.alias("_key"), F.col(row_id).alias("_id"))
    place = place.withColumn("_bucket", hash_bucket("_key", digits))
    offsets = bucket_offsets(place, [label], "_bucket", {"_n": F.count(F.lit(1))})
    counts = offsets.groupBy(label).agg(F.sum("_n").alias("_n"))
    room = F.col("_quota") - F.col("_n_before")
    boundary = (with_offsets(offsets, class_quotas(counts, label, share), [label], ["_quota"])
                .where((room > 0) & (room <= F.col("_n")))
                .select(label, "_bucket", room.alias("_room")))
    inside = Window.partitionBy(label, "_bucket").orderBy("_key", "_id")
    last = (with_offsets(place, boundary, [label, "_bucket"], ["_room"])
            .where(F.col("_room").isNotNull())
            .withColumn("_turn", F.row_number().over(inside)).where("_turn = _room")
            .select(label, F.struct("_key", "_id").alias("_last")))
    marked = with_offsets(df, last, [label], ["_last"])
    own = F.struct(key.alias("_key"), F.col(row_id).alias("_id"))
    return marked.withColumn("is_test", F.coalesce(own <= F.col("_last"), F.lit(False))) \
                 .drop("_last")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = params.FOLDS,
                     seed: int = params.SEED, digits: int = HASH_DIGITS) -> DataFrame:
    """Add int `fold` in [0, k): rows of a class dealt in turn by hash order."""
    keyed = df.withColumn("_key", hash_key(row_id, seed=seed))
    keyed = keyed.withColumn("_bucket", hash_bucket("_key", digits))
    ranked = running_rank(keyed, [label], "_bucket", ["_key", row_id], "_rank")
    return (ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int"))
            .drop("_key", "_bucket", "_rank"))


def sample_first_n(df: DataFrame, row_id: str, n: int = params.SAMPLE_ROWS,
                   seed: int = params.SEED) -> DataFrame:
    """At most `n` rows, the same ones on every run; a per-partition top-n, then a merge."""
    return df.orderBy(hash_key(row_id, seed=seed), row_id).limit(n)
