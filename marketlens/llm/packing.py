"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

A document longer than a sequence fills whole sequences of its own; what is left, or a shorter
document, is a piece. Two pieces conflict if they share a source or a duplicate cluster, which
for a table of documents is the class of near-duplicates. Bins are ordered by their free room
and carry a bitmap of their sources and one of their clusters. Pieces come longest first; each
goes to the tightest bin with enough room that does not conflict, found by walking from the
first bin with enough room to its successors, and opens a bin if there is none.

Pieces are dealt by hash into groups of bounded size, which pack independently; a group's
last bins are all that the cut costs. A hot source is spread over all groups.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import neardup
from marketlens.llm.common import SPACE, stored, table

CAPACITY = 2048
#: Mean pieces of a group.
GROUP_ROWS = 4000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int
             ) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, in the given order of pieces.

    Sources and clusters that come once cannot conflict and get no bit; None never conflicts.
    """
    def bits(values: list) -> list[int]:
        often = [v for v, n in Counter(values).items() if v is not None and n > 1]
        place = {v: 1 << i for i, v in enumerate(often)}
        return [place.get(v, 0) for v in values]

    source_bits, cluster_bits = bits(sources), bits(clusters)
    # (free room, bin) in order, with the bins' bitmaps at the same places of two more lists:
    # the walk then reads neighbours in memory.
    rooms: list[tuple[int, int]] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, offsets, opened = [], [], 0
    for size, source, cluster in zip(sizes, source_bits, cluster_bits):
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held_sources[at] & source or held_clusters[at] & cluster):
            at += 1
        if at == len(rooms):
            room, number, own_sources, own_clusters = capacity, opened, 0, 0
            opened += 1
        else:
            room, number = rooms.pop(at)
            own_sources, own_clusters = held_sources.pop(at), held_clusters.pop(at)
        bins.append(number)
        offsets.append(capacity - room)
        if room > size:
            entry = (room - size, number)
            at = bisect_left(rooms, entry)
            rooms.insert(at, entry)
            held_sources.insert(at, own_sources | source)
            held_clusters.insert(at, own_clusters | cluster)
    return bins, offsets


def word_tokens(text: Column) -> Column:
    """White-space separated words plus one end token; null: just the end token."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")
    return F.size(words).cast("long") + 1


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.monotonically_increasing_id())


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_tokens, bin, offset, source).

    `docs` has doc_id, source, cluster and n_tokens; other columns are not read. `start` is
    the piece's first token in its document, `offset` its place in the bin; all pieces of a
    document tile it. Bins are numbered without gaps inside a group and are unique over all.
    A null source or cluster conflicts with nothing; a null, zero or negative length gives no
    piece. Rows are numbered first, so ids may be null or repeat. No rows give no rows.
    """
    return _pack(_numbered(docs.select("doc_id", "source", "cluster", "n_tokens")),
                 capacity, group_rows)


def _pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pack` of rows that are numbered already."""
    full = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") - full * capacity
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / capacity) - 1),
        lambda i: F.struct(i.alias("piece"), (i * capacity).alias("start"),
                           F.when(i < full, capacity).otherwise(rest).cast("long").alias("n_tokens")))
    numbered = stored(
        docs.where("n_tokens > 0").select(
            "row", "doc_id", "source", "cluster", F.inline(pieces)), "pack-pieces")
    groups = max(1, -(-numbered.count() // group_rows))
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def packed(group: pa.Table) -> pa.Table:
        sizes = group["n_tokens"].to_numpy()
        # Longest first; ties by row and piece, so that a task run again packs alike.
        order = np.lexsort((group["piece"].to_numpy(), group["row"].to_numpy(), -sizes))
        group = group.take(pa.array(order))
        bins, offsets = best_fit(group["n_tokens"].to_pylist(), group["source"].to_pylist(),
                                 group["cluster"].to_pylist(), capacity)
        first = group["group"][0].as_py() << 32
        return (group.select(["doc_id", "piece", "start", "n_tokens"])
                .append_column("bin", pa.array(np.array(bins, np.int64) + first))
                .append_column("offset", pa.array(offsets, pa.int64()))
                .append_column("source", group["source"]))

    schema = (numbered.select("doc_id", "piece", "start", "n_tokens").schema
              .add("bin", "long").add("offset", "long")
              .add("source", numbered.schema["source"].dataType))
    return dealt.groupBy("group").applyInArrow(packed, schema)


def word_sequence(text: Column) -> Column:
    """Cluster of the texts with the same lower-cased words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), "")
    return F.md5(F.array_join(words, " "))


def pack_documents(docs: DataFrame, cluster: Column | None = None, **options: int) -> DataFrame:
    """Packs a documents table: words as tokens, near-duplicates as one cluster.

    Texts count lower-cased and without outer white space, so those of the same word sequence
    are one class, as are all without words. A `cluster` given takes the place of the classes.
    """
    if cluster is not None:
        length = word_tokens(docs["text"]).alias("n_tokens")
        return pack(docs.select("doc_id", "source", cluster.alias("cluster"), length), **options)
    space = F.lit("".join(map(chr, (32, *range(9, 14)))))
    plain = F.lower(F.btrim(F.coalesce("text", F.lit("")), space))
    # Words and sources come out of the pass that reads the texts for their signatures.
    rows, classes = neardup.classify(docs.select("doc_id", plain.alias("text"), "source"),
                                     carry=("source",))
    # A node alone is its own root; only the others are joined, so that a hot one can be split.
    moved = stored(classes.where("node <> root"), "pack-classes")
    # Numbered before the join, so that its order does not matter.
    rows = _numbered(rows.select(
        "doc_id", "source", (F.col("words") + 1).alias("n_tokens"), "node"))
    return _pack(rows.join(moved, "node", "left").withColumn(
        "cluster", F.coalesce("root", "node")), **options)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
