"""Packing by concatenation: all token ids in one line, cut into windows of equal length.

Pass one encodes every document once, where it is read, and writes its ids with the number of
its part (the writing task) and its place among that part's ids. Pass two adds up the parts'
totals, one row each, to the offset of every part; offset plus place is a document's position
in the whole line. Windows are cut at the multiples of the capacity of that line, so every
sequence but the last is full, and no document is shuffled.

`pieces` lists what lies where. `sequences` builds the windows themselves: those inside a run of
neighbouring documents are cut in the task that reads them, and only the two rests of such a
run, its boundary records, are exchanged and joined with their neighbours'.
"""

from __future__ import annotations

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
END_ID, PAD_ID = 1, 0
CAPACITY = 2048
#: Bytes of an id: little-endian, unsigned.
WIDTH = 4
#: Documents encoded together, so that a batch's ids stay small.
_ROWS = 256


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER,
              end_id: int = END_ID) -> None:
    """Pass one: Parquet rows (doc_id, part, place, n_tokens, ids), ids as 4-byte integers.

    Null and empty texts are the end id alone. Ids may be null or repeat: every row is a
    document of its own. A text is encoded whole, whatever its length (one text must fit in a
    worker's memory with its ids). Other columns are not read. An empty table writes no rows.
    """
    numbered = docs.select("doc_id", F.spark_partition_id().alias("part"), "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, place = byte_bpe(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                some = batch.slice(a, _ROWS)
                ids = [bpe.encode(t.as_py()).astype("<u4").tobytes() + end
                       for t in some.column(2)]
                n = np.array([len(x) // WIDTH for x in ids], np.int64)
                ends = place + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(ends - n), pa.array(n),
                     pa.array(ids, pa.binary())],
                    ["doc_id", "part", "place", "n_tokens", "ids"])
                place = int(ends[-1])

    schema = T.StructType([
        numbered.schema["doc_id"], numbered.schema["part"], T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    (numbered.mapInArrow(encoded, schema).write.option("compression", "zstd")
     .option("parquet.enable.dictionary", "false").parquet(path))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Pass two: (doc_id, position, n_tokens, ids), the position counting all ids before.

    The table of totals has one row for each task that wrote, so it is small at any size of
    the input: as many rows as the driver has tasks to track. It is broadcast for that reason.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("position"), "n_tokens", "ids")


def pieces(line: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document and window it reaches into, from `positions`.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): `start` counts the
    document's ids before the piece, `offset` the window's.
    """
    position, n = F.col("position"), F.col("n_tokens")

    def piece(window: F.Column) -> F.Column:
        start = F.greatest(window * capacity - position, F.lit(0))
        length = F.least((window + 1) * capacity - position, n) - start
        bytes_of = F.col("ids").substr((start * WIDTH + 1).cast("int"),
                                       (length * WIDTH).cast("int"))
        return F.struct(
            start.alias("start"), length.alias("length"), F.crc32(bytes_of).alias("ids_crc32"),
            window.alias("sequence_id"),
            (position + start - window * capacity).alias("offset"))

    windows = F.sequence(F.floor(position / capacity), F.floor((position + n - 1) / capacity))
    return line.select("doc_id", n.alias("doc_tokens"), F.inline(F.transform(windows, piece))
                       ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                "sequence_id", "offset")


def sequences(line: DataFrame, capacity: int = CAPACITY, pad_id: int = PAD_ID) -> DataFrame:
    """(sequence_id, n_tokens, ids) of all windows, from `positions`; ids as 4-byte integers.

    Every window but the last has `capacity` ids of documents. The last is filled up with
    `pad_id`, except if its length is a power of two; `n_tokens` counts without the filling.
    """
    step = capacity * WIDTH

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = bytearray(), 0  # ids in hand and the position of the first

        def emit(last: bool) -> pa.RecordBatch:
            """Whole windows in hand, and what is left of a run that has ended."""
            nonlocal first
            rows, at = [], 0
            while True:
                window, offset = divmod(first, capacity)
                size = min((capacity - offset) * WIDTH, len(held) - at)
                if not size or (size < (capacity - offset) * WIDTH and not last):
                    break
                rows.append((window, offset, bytes(held[at:at + size]), size == step))
                at, first = at + size, first + size // WIDTH
            del held[:at]
            columns = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(),
                                                          pa.bool_()))],
                ["sequence_id", "offset", "ids", "whole"])

        for batch in batches:
            for position, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if position != first + len(held) // WIDTH:
                    yield emit(last=True)
                    first = position
                held += ids.as_buffer()
                if len(held) >= 64 * step:
                    yield emit(last=False)
        yield emit(last=True)

    found = line.select("position", "ids").mapInArrow(
        cut, "sequence_id long, offset long, ids binary, whole boolean")
    # A window has at most as many fragments as ids.
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = found.where("not whole").groupBy("sequence_id").agg(F.aggregate(
        ordered, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))
    every = found.where("whole").select("sequence_id", "ids").unionByName(joined)
    n = (F.octet_length("ids") / WIDTH).cast("int")
    one = F.lit(int(pad_id).to_bytes(WIDTH, "little"))
    filled = F.when((n < capacity) & (F.bit_count(n) != 1), F.concat(
        "ids", F.unhex(F.repeat(F.hex(one), F.lit(capacity) - n)))).otherwise(F.col("ids"))
    return every.select("sequence_id", n.cast("long").alias("n_tokens"), filled.alias("ids"))


def op12_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every piece of every document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = new_path(spark, "packed-ids")
    write_ids(docs, path)
    return pieces(positions(spark, path))
