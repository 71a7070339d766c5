"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in blocks. For every (block, shard) pair the number of rows that move is drawn from
the multivariate hypergeometric law, so that each shard gets exactly its size. Each block is
permuted and cut by its row of the matrix, the rows are exchanged, and each shard is permuted
again, in slices, so that a few large shards still use many tasks. The outcome is a uniform
random permutation of all rows.

The driver sees block and slice counts only and draws a (blocks x shards) matrix; these
numbers are parameters and do not grow with the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import slots, stored, table

SHARDS = 16
SEED = 20240607


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards get the remainder."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` from `good + bad`, by inversion around the mode.

    Works for populations beyond the 10^9 limit of library samplers. The window of 40
    standard deviations leaves out less than 10^-300 of the mass.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    share = good / total
    spread = (draws * share * (1 - share) * max(1, total - draws) / max(1, total - 1)) ** 0.5
    reach = int(40 * spread) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    # log p(k + 1) - log p(k)
    steps = (np.log(good - k) + np.log(draws - k) - np.log(k + 1)
             - np.log(bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(blocks: list[int], cells: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows sent from each block to each cell: row sums `blocks`, column sums `cells`."""
    if sum(blocks) != sum(cells):
        raise ValueError("blocks and cells hold different numbers of rows")
    rng, left, matrix = np.random.default_rng(seed), list(cells), []
    for size in blocks:
        row, draws, others = [], size, sum(left)
        for j, room in enumerate(left):
            others -= room
            taken = hypergeometric(rng, room, others, draws) if draws else 0
            row.append(taken)
            draws -= taken
            left[j] -= taken
        matrix.append(row)
    return matrix


def _numbers(values: list[int]) -> Column:
    """A literal array, parsed as one text instead of one call per entry."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _counts(df: DataFrame, group: Column, groups: int) -> list[int]:
    """Rows of each group 0 to groups - 1."""
    found = {r["g"]: r["n"] for r in
             df.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    return [found.get(g, 0) for g in range(groups)]


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, blocks: int | None = None,
                      seed: int = SEED, row_id: str | None = None) -> DataFrame:
    """All rows of `df` with `shard` (0 to shards - 1) and `slot` (gapless from 0 per shard).

    Shard sizes differ by one row at most. `row_id` names a column unique over all rows; if
    there is none, rows are numbered and stored once, so nulls, ties and repeated rows are
    each a row of their own and a recomputed task sees the same numbers. `blocks` is how many
    source blocks there are, the session's shuffle partitions by default. An empty table
    gives no rows. A column of `df` that is called `shard` or `slot` is replaced.
    """
    spark = df.sparkSession
    blocks = blocks or slots(spark)
    slices = max(1, blocks // shards)
    row = F.struct(*(df[c] for c in df.columns if c not in ("shard", "slot"))).alias("row")
    if row_id is None:
        numbered = stored(df.select(row, F.monotonically_increasing_id().alias("id")),
                          "shard-rows")
    else:
        numbered = df.select(row, df[row_id].alias("id"))
    keyed = numbered.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)))
    held = _counts(keyed, F.col("block"), blocks)
    matrix = communication_matrix(held, shard_sizes(sum(held), shards), seed)
    # Where each (block, shard) run ends in the block's order, block after block.
    ends = [int(e) for sent in matrix for e in np.cumsum(sent)]

    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    sent = (keyed.withColumn("rank", F.row_number().over(local))
            .withColumn("cuts", F.slice(_numbers(ends), F.col("block").cast("int") * shards + 1,
                                        F.lit(shards)))
            # Shards whose run ends before this row: runs are in order, so this is its shard.
            .withColumn("shard", F.size(F.filter("cuts", lambda end: end < F.col("rank"))))
            .withColumn("cell", F.col("shard") * slices
                        + F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(slices)))
            .select("row", "id", "shard", "cell"))
    sent = stored(sent, "shard-exchange")
    sizes = _counts(sent, F.col("cell"), shards * slices)
    before = [sum(sizes[i - i % slices:i]) for i in range(len(sizes))]
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 3), "id"), "id")
    return (sent.withColumn("slot", F.row_number().over(again) - 1 + F.element_at(
                _numbers(before), F.col("cell").cast("int") + 1))
            .select("row.*", "shard", F.col("slot").cast("long")))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards by the `rows` law: counts at most one apart.

    A null text has size 1 and the checksum of the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_to_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
