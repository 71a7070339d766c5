"""Token ids in Parquet list columns.

Rows are put in ascending order of id by a range exchange, encoded in that order and written
by Spark's Parquet writer with settings of the format's own: ids as a dictionary or delta
encoded list column, row groups and pages of chosen size, page indexes (which the writer always
adds), one column each for id, length and position. A reader that wants the lengths of all
documents or the ids of a few reads those columns and pages only.

Each file holds its part's number and every document's position inside the part. The position
in the whole collection is the part's offset, a running sum over one total per part, plus that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.byte_bpe import byte_bpe
from marketlens.llm.common import table
from marketlens.sources.workspace import new_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 parts: int | None = None, delta: bool = False) -> None:
    """Files of (doc_id, part, local_start, n_tokens, ids) in ascending order of doc_id.

    `end_id` follows every document; null and empty texts are that id alone. Null ids come
    first and equal ids stay together, ordered by text digest; other columns are not read. An
    empty table gives files without rows. `delta` writes ids with the format's version 2
    encodings instead of a dictionary, for vocabularies too large for one.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_digest"]
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("_digest"))
               .repartitionByRange(parts, *order).sortWithinPartitions(*order)
               .select("doc_id", F.spark_partition_id().alias("part"), "text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, before = byte_bpe(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            # A few hundred documents at a time, so that list offsets stay small.
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                ids = [bpe.encode(t.as_py()).astype("<u4").tobytes() + end
                       for t in some.column(2)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]),
                                               [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(before + ends - n),
                     pa.array(n), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])

    schema = (ordered.select("doc_id", "part").schema.add("local_start", "long")
              .add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())))
    (ordered.mapInArrow(encoded, schema).write
     .option("compression", "zstd")
     .option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "false" if delta else "true")
     .option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; `start` counts all ids before a document.

    Part totals come from the length column alone, one row per part, so they are small at any
    size of the collection and are broadcast; no id is exchanged.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents; the ids are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_some(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """`read_tokens` of the documents from `low` to `high`. Files are in order of doc_id, so
    the scan skips row groups and pages outside by their statistics."""
    return read_tokens(spark, path).where(F.col("doc_id").between(low, high))


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """`tokens` with the checksum of each id list (as little-endian 32-bit) in its place."""
    names = [c for c in tokens.columns if c != "ids"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())],
                                             [*names, "ids_crc32"])

    schema = tokens.select(*names).schema.add("ids_crc32", "long")
    return tokens.select(*names, "ids").mapInArrow(summed, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, from files written and read."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = new_path(spark, "token-files")
    write_tokens(docs, path)
    return ids_crc32(read_tokens(spark, path))
