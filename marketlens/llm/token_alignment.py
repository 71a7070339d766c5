"""Alignment of two tokenizers over the same bytes, counted over the corpus.

Both tokenizers spell a document as the same bytes: a space and the text. Byte offsets where a
token of A and one of B both end cut the document into groups, and all A tokens of a group are
linked with all its B tokens.

Documents are merged in lockstep. A block of documents lies in two arrays of token ends; one
NumPy state vector holds an A and a B pointer for each of its lanes, a lane being a document or
a stretch of a long one between two common cuts. Every step compares the two ends of all lanes
at once, moves the pointer that is behind (both at a cut), emits the cuts and links found and
drops finished lanes from the vector. Stretches are of bounded length, so the number of steps
is, too, whatever the longest document.

Counts of linked id pairs go through the corpus as one small dictionary per block, not per
document: pairs are added up over blocks, every A id's largest count is found, and both come
back to the block, where the documents refer to pairs by their place in its dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.byte_bpe import ByteBPE, byte_bpe, find_file
from marketlens.llm.common import stored, table

TOKENIZER_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text in a block, and A tokens of a lane.
BLOCK_CHARS, LANE = 2 << 20, 256
#: Bits of an id in a pair of two.
_BITS = 20


class PieceModel:
    """Ids of a piece model; `entry[i]` is what id i stands for, as bytes."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entry = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.entry.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


_models: dict[str, PieceModel] = {}


def piece_model(model: str) -> PieceModel:
    """The model, once per worker."""
    path = find_file(model)
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _spelled(entries: pa.BinaryArray, ids: list[np.ndarray]) -> tuple[np.ndarray, memoryview]:
    """Bytes of every id of all documents, their lengths, and all of them joined."""
    every = np.concatenate(ids) if ids else np.empty(0, np.int64)
    taken = entries.take(pa.array(every))
    sizes = np.diff(np.frombuffer(taken.buffers()[1], np.int64)[:len(every) + 1])
    data = taken.buffers()[2]
    return sizes, memoryview(data) if data is not None else memoryview(b"")


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lanes(starts_a: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, lane: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """A and B positions where lanes start (and the end): documents, cut about every `lane`."""
    lengths = np.diff(starts_a)
    parts = np.maximum(-(-lengths // lane), 1)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (np.repeat(starts_a[:-1], parts) + number * lane)[number > 0]
    # On to the next common end; there is one at the end of the document at the latest.
    found = []
    while len(at):
        end = ends_a[at - 1]
        common = ends_b[np.searchsorted(ends_b, end)] == end
        found.append(at[common])
        at = at[~common] + 1
    bounds = np.unique(np.concatenate([starts_a, *found]))
    ends = np.where(bounds > 0, ends_a[np.maximum(bounds, 1) - 1], 0)
    return bounds, np.where(ends > 0, np.searchsorted(ends_b, ends) + 1, 0)


def merge(starts_a: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last A, last B of every group; A, B of every link) as token positions, in no order.

    `ends_a` and `ends_b` are byte ends of all tokens of all documents, one after another;
    document d has the A tokens from starts_a[d] to starts_a[d + 1].
    """
    none = np.empty(0, np.int64)
    if not len(ends_a):
        return none, none, none, none
    bounds_a, bounds_b = _lanes(starts_a, ends_a, ends_b, lane)
    i, j, stop = bounds_a[:-1].copy(), bounds_b[:-1].copy(), bounds_a[1:]
    first_a, first_b = i.copy(), j.copy()  # where the open group of a lane starts
    cuts, links = [], []
    while len(i):
        end_a, end_b = ends_a[i], ends_b[j]
        at = np.flatnonzero(end_a == end_b)
        if len(at):
            last_a, last_b = i[at], j[at]
            cuts.append((last_a, last_b))
            links.append(_product(first_a[at], last_a, first_b[at], last_b))
        i += end_a <= end_b
        j += end_b <= end_a
        first_a[at], first_b[at] = i[at], j[at]
        live = i < stop
        if not live.all():
            i, j, stop, first_a, first_b = (x[live] for x in (i, j, stop, first_a, first_b))
    return (*(np.concatenate(x) for x in zip(*cuts)), *(np.concatenate(x) for x in zip(*links)))


def _product(first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of A and B tokens of every group."""
    n_b = last_b - first_b + 1
    n = (last_a - first_a + 1) * n_b
    if n.max() == 1:
        return last_a, last_b
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    n_b = np.repeat(n_b, n)
    return np.repeat(first_a, n) + k // n_b, np.repeat(first_b, n) + k % n_b


@dataclass
class Block:
    """Aligned documents; documents without tokens have none of anything."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    #: Position after the last A and B token of every group, in order.
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    group_starts: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray


class Aligner:
    def __init__(self, tokenizer_a: str, model_b: str) -> None:
        self.a: ByteBPE = byte_bpe(tokenizer_a)
        self.b: PieceModel = piece_model(model_b)
        size = max(self.a.entry, default=0) + 1
        if max(size, len(self.b.entry)) >> _BITS:
            raise ValueError(f"ids of more than {_BITS} bits")
        self.entries_a = pa.array([self.a.entry.get(i, b"") for i in range(size)],
                                  pa.large_binary())
        self.entries_b = pa.array(self.b.entry, pa.large_binary())
        # Decimal id with what follows it in the digest: in a group, at its A end, at its end.
        every = [str(i) for i in range(max(size, len(self.b.entry)))]
        self.width = len(every)
        self.decimals = pa.array([d + mark for mark in ",|;" for d in every], pa.large_string())

    def align(self, texts: list[str | None], lane: int = LANE) -> Block:
        full = [d for d, text in enumerate(texts) if text]
        raw = [b" " + texts[d].encode("utf-8") for d in full]
        ids_a = [self.a.encode_plain(" " + texts[d]).astype(np.int64) for d in full]
        ids_b = self.b.encode([texts[d] for d in full]) if full else []
        good = np.ones(len(full), bool)
        for entries, ids in ((self.entries_a, ids_a), (self.entries_b, ids_b)):
            sizes, data = _spelled(entries, ids)
            at = _starts(sizes)[_starts(np.array([len(x) for x in ids], np.int64))]
            for k, want in enumerate(raw):
                good[k] &= bytes(data[at[k]:at[k + 1]]) == want
        ids_a = [x for x, ok in zip(ids_a, good) if ok]
        ids_b = [x for x, ok in zip(ids_b, good) if ok]
        place = np.array(full, np.int64)[good]

        def starts(ids: list[np.ndarray]) -> np.ndarray:
            lengths = np.zeros(len(texts), np.int64)
            lengths[place] = [len(x) for x in ids]
            return _starts(lengths)

        starts_a, starts_b = starts(ids_a), starts(ids_b)
        sizes_a, sizes_b = _spelled(self.entries_a, ids_a)[0], _spelled(self.entries_b, ids_b)[0]
        # Both spell the same bytes, so documents end at equal offsets of the whole block.
        cut_a, cut_b, link_a, link_b = merge(
            starts_a, np.cumsum(sizes_a), np.cumsum(sizes_b), lane)
        cuts_a, cuts_b = np.sort(cut_a) + 1, np.sort(cut_b) + 1
        return Block(np.concatenate([np.empty(0, np.int64), *ids_a]),
                     np.concatenate([np.empty(0, np.int64), *ids_b]), starts_a, starts_b,
                     cuts_a, cuts_b, np.searchsorted(cuts_a, starts_a, side="right"),
                     link_a, link_b)

    def digests(self, block: Block) -> list[str]:
        """SHA-256 of every document's groups, `a1,a2|b1;a3|b2`; '' without tokens."""
        n_a, n_b = len(block.ids_a), len(block.ids_b)
        group_a = np.searchsorted(block.cuts_a, np.arange(n_a), side="right")
        group_b = np.searchsorted(block.cuts_b, np.arange(n_b), side="right")
        # An A token follows all B tokens of earlier groups, a B token all A tokens of its own.
        before = np.concatenate([[0], block.cuts_b])
        mark = np.empty(n_a + n_b, np.int64)
        in_a, in_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        in_a[block.cuts_a - 1], in_b[block.cuts_b - 1] = 1, 2
        mark[np.arange(n_a) + before[group_a]] = in_a * self.width + block.ids_a
        mark[np.arange(n_b) + block.cuts_a[group_b]] = in_b * self.width + block.ids_b
        taken = self.decimals.take(pa.array(mark))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)
        data = memoryview(taken.buffers()[2]) if len(mark) else memoryview(b"")
        ends = offsets[block.starts_a + block.starts_b] if len(mark) else block.starts_a
        return [hashlib.sha256(data[a:b - 1]).hexdigest() if b > a else ""
                for a, b in zip(ends[:-1], ends[1:])]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer_a: str, model_b: str) -> Aligner:
    """The pair of tokenizers, once per worker."""
    key = find_file(tokenizer_a), find_file(model_b)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _blocks(batches: Iterator[pa.RecordBatch], chars: int
            ) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of about `chars` characters; a longer text is a block of its own."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = held = 0
        for k, text in enumerate(texts):
            held += len(text or "") + 100
            if held >= chars or k + 1 == len(texts):
                yield batch.column("doc_id").slice(start, k + 1 - start), texts[start:k + 1]
                start, held = k + 1, 0


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)),
                                    pa.array(values.astype(kind.to_pandas_dtype())))


def groups(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, model_b: str = MODEL_B
           ) -> DataFrame:
    """(doc_id, ids_a, ids_b, ends_a, ends_b): tokens of both and where each group ends.

    Ends count the document's tokens up to and with the group's last. Nulls, empty texts and
    other cases are as in `alignment`.
    """
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(tokenizer_a, model_b)
        for ids, texts in _blocks(batches, BLOCK_CHARS):
            b = pair.align(texts)
            own = np.repeat(np.arange(len(texts)), np.diff(b.group_starts))
            yield pa.RecordBatch.from_arrays(
                [ids, _lists(b.ids_a, b.starts_a, pa.int32()),
                 _lists(b.ids_b, b.starts_b, pa.int32()),
                 _lists(b.cuts_a - b.starts_a[own], b.group_starts, pa.int32()),
                 _lists(b.cuts_b - b.starts_b[own], b.group_starts, pa.int32())],
                ["doc_id", "ids_a", "ids_b", "ends_a", "ends_b"])

    kept = docs.select("doc_id", "text")
    schema = kept.select("doc_id", *(F.array().cast("array<int>").alias(c) for c in (
        "ids_a", "ids_b", "ends_a", "ends_b"))).schema
    return kept.mapInArrow(aligned, schema)


def alignment(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, model_b: str = MODEL_B,
              block_chars: int = BLOCK_CHARS, lane: int = LANE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A link's count is the number of rows of `docs` that hold its id pair linked; `n_best` are
    the links whose count is the largest of their A id, ties included. Null and empty texts,
    and texts that either tokenizer spells as other bytes than a space and the text, have no
    tokens: zeros and an empty digest. Ids may be null or repeat: every row is a document. A
    text is aligned whole, whatever its length. An empty table gives no rows; other columns
    are not read.
    """
    held = docs.select("doc_id", F.spark_partition_id().cast("long").alias("block"), "text")
    names = ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
             "places", "times", "pairs", "docs"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, turn, part = aligner(tokenizer_a, model_b), 0, 0

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("block")[0].as_py()
                yield batch

        for ids, texts in _blocks(noted(), block_chars):
            b, n = pair.align(texts, lane), len(texts)
            own = np.repeat(np.arange(n), np.diff(b.starts_a))[b.links_a]
            key = np.sort(own << 2 * _BITS | b.ids_a[b.links_a] << _BITS | b.ids_b[b.links_b])
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
            of, code = key[new] >> 2 * _BITS, key[new] & (1 << 2 * _BITS) - 1
            times = np.diff(np.append(new, len(key)))
            pairs, places, seen = np.unique(code, return_inverse=True, return_counts=True)
            starts = np.searchsorted(of, np.arange(n + 1))
            number = np.full(n, (part << 32) + turn)
            nothing = [pa.nulls(n, pa.list_(t)) for t in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number), pa.array(np.diff(b.starts_a)),
                 pa.array(np.diff(b.starts_b)), pa.array(np.diff(b.group_starts)),
                 pa.array(np.bincount(own, minlength=n)), pa.array(pair.digests(b), pa.string()),
                 _lists(places, starts, pa.int32()), _lists(times, starts, pa.int32()),
                 *nothing], names)
            one = np.array([0, len(pairs)])
            nulls = [pa.nulls(1, t) for t in (
                ids.type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2)]
            yield pa.RecordBatch.from_arrays(
                [nulls[0], pa.array(number[:1]), *nulls[1:],
                 _lists(pairs, one, pa.int64()), _lists(seen, one, pa.int32())], names)
            turn += 1

    longs = [F.lit(0).cast("long").alias(c) for c in names[2:6]]
    ints = {c: F.array().cast("array<int>").alias(c) for c in ("places", "times", "docs")}
    schema = held.select(
        "doc_id", F.expr("if(block is null, null, block)").alias("block"), *longs,
        F.lit("").alias("groups_sha256"), ints["places"], ints["times"],
        F.array().cast("array<long>").alias("pairs"), ints["docs"]).schema
    for one in schema:
        one.nullable = True
    rows = stored(held.mapInArrow(aligned, schema), "aligned")

    entries = rows.where("pairs is not null").select(
        "block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "e")
    ).select("block", "place", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"))
    id_a = F.shiftright("pair", _BITS)
    counts = stored(entries.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    # One row per id of A's vocabulary at most, so it may be broadcast at any size of corpus.
    best = counts.groupBy(id_a.alias("a")).agg(F.max("count").alias("most"))
    rated = counts.join(F.broadcast(best), id_a == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = entries.join(rated, "pair").select(
        F.col("block").alias("of"), "place", "count", "best")
    out = names[:1] + ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       "groups_sha256"]

    def looked_up(found: pa.Table, rated: pa.Table) -> pa.Table:
        size = rated.num_rows
        count, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = rated["place"].to_numpy()
        count[at], top[at] = rated["count"].to_numpy(), rated["best"].to_numpy()
        places, times = (found[c].combine_chunks() for c in ("places", "times"))
        use = places.flatten().to_numpy()
        often = times.flatten().to_numpy()
        starts = _starts(np.diff(places.offsets.to_numpy()))

        def per_document(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(_starts(values * often)[starts]))

        return (found.append_column("n_best", per_document(top[use]))
                .append_column("count_sum", per_document(count[use])).select(out))

    final = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                        F.col("n_a").alias("n_best"), F.col("n_a").alias("count_sum"),
                        "groups_sha256").schema
    texts = rows.where("pairs is null").drop("pairs", "docs")
    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(looked_up, final)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of every document."""
    return alignment(table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"))
