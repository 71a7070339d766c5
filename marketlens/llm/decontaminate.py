"""Benchmark passages in training texts by spaced-seed hashing.

A mask selects some of the words in a window and ignores the rest, so a window still hashes
alike when an ignored word was replaced. Every window of every benchmark item and of every
document is hashed under each mask; equal hashes give a place in both texts. Around such a hit
the two texts are compared word by word on the same diagonal. Of all stretches there whose
share of equal words is high enough, the one with most equal words counts: a reward for equal
and a charge for replaced words are such that just these stretches have no negative sum.

Items shorter than the shortest mask have a mask of their own length that selects every word.
In scripts without spaces every character is a word.

Benchmark items come in blocks of bounded size, so any number of items works: each block is
sent to the executors and all documents are scanned once per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import stored, table

#: 1 selects a word, 0 ignores it.
MASKS = ("1111111", "111101111", "11101101011")
#: Words that must be equal in a stretch, share of equal words in it.
MIN_EQUAL, MIN_SHARE = 12, 0.8
#: Items of fewer words are no evidence inside a text; only a text of just these words counts.
MIN_WORDS = 3
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
#: Bits of the table that sorts out most windows before hashes are searched.
_FILTER_BITS = 22
_PRIME = np.uint64(0x9E3779B97F4A7C15)
# Code points of scripts that are written without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, or single characters of an unspaced script: case
    and punctuation do not matter."""
    return _WORD.findall((text or "").lower())


def _hashes(words: list[str]) -> np.ndarray:
    code: dict[str, int] = {}
    for w in words:
        if w not in code:
            code[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(code.__getitem__, words), np.uint64, len(words))


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of a word-hash array under one mask."""
    n = len(codes) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1":
            out = (out ^ codes[i:i + n]) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def best_stretch(equal: np.ndarray, share: float = MIN_SHARE) -> tuple[int, int]:
    """Start and end of the stretch with most equal words among all of at least that share."""
    if not equal.any():
        return 0, 0
    part = Fraction(share).limit_denominator(1000)
    total = np.concatenate([[0], np.cumsum(np.where(
        equal, part.denominator - part.numerator, -part.numerator))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # The first start from which the sum up to each end is not negative.
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(count - count[start]))
    return int(start[end] + np.argmax(equal[start[end]:end])), end


@dataclass(frozen=True)
class Block:
    """Benchmark items ready for the search: word hashes of all items in one array."""

    ids: list[int | None]
    codes: np.ndarray
    starts: np.ndarray
    #: Per mask: hashes in order and the places of their windows in `codes`.
    seeds: list[tuple[str, np.ndarray, np.ndarray]]
    filter: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Block:
        parts = [_hashes(words_of(t)) for _, t in items]
        starts = np.cumsum([0, *map(len, parts)])
        codes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        seeds = []
        least = min(map(len, MASKS))
        short = sorted({len(p) for p in parts if 0 < len(p) < least})
        for mask in (*MASKS, *("1" * n for n in short)):
            # A short mask is for the items of just its length.
            each = [seed_hashes(p, mask) if len(mask) >= least or len(p) == len(mask)
                    else p[:0] for p in parts]
            at = np.concatenate([starts[i] + np.arange(len(h)) for i, h in enumerate(each)]
                                or [np.empty(0, np.int64)]).astype(np.int64)
            value = np.concatenate(each or [np.empty(0, np.uint64)])
            order = np.argsort(value, kind="stable")
            seeds.append((mask, value[order], at[order]))
            bits[value >> np.uint64(64 - _FILTER_BITS)] = True
        return cls([i for i, _ in items], codes, starts, seeds, bits)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, first word, end word, equal words) of each item's best verified overlap."""
        if not len(self.codes):
            return []
        codes = _hashes(words_of(text))
        diagonals = [np.empty((0, 2), np.int64)]
        for mask, values, places in self.seeds:
            if len(mask) < MIN_WORDS and len(codes) != len(mask):
                continue
            own = seed_hashes(codes, mask)
            at = np.flatnonzero(self.filter[own >> np.uint64(64 - _FILTER_BITS)])
            first = np.searchsorted(values, own[at], "left")
            times = np.searchsorted(values, own[at], "right") - first
            at, first, times = at[times > 0], first[times > 0], times[times > 0]
            if len(at):
                # All postings of all hits at once.
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                place = places[np.repeat(first, times) + turn]
                item = np.searchsorted(self.starts, place, "right") - 1
                shift = np.repeat(at, times) - (place - self.starts[item])
                diagonals.append(np.unique(np.stack([item, shift], axis=1), axis=0))
        best: dict[int, tuple[int, int, int]] = {}
        # The same words of an item and a text give the same result, wherever they stand.
        known: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
        for item, shift in np.unique(np.concatenate(diagonals), axis=0).tolist():
            own = self.codes[self.starts[item]:self.starts[item + 1]]
            low, high = max(0, -shift), min(len(own), len(codes) - shift)
            if item in best and best[item][0] >= high - low:
                continue
            mine, theirs = own[low:high], codes[low + shift:high + shift]
            pair = mine.tobytes(), theirs.tobytes()
            if pair not in known:
                equal = mine == theirs
                a, b = best_stretch(equal)
                known[pair] = a, b, int(np.count_nonzero(equal[a:b]))
            a, b, n = known[pair]
            if n >= min(MIN_EQUAL, len(own)) and n > best.get(item, (0,))[0]:
                best[item] = n, low + shift + a, low + shift + b
        return sorted(((self.ids[item], a, b, n) for item, (n, a, b) in best.items()),
                      key=lambda f: (f[0] is not None, *(v or 0 for v in f)))


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about `block_bytes` of text, one block on the driver at a time."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    if n > 1:
        items = stored(items, "benchmark-items")
    for i in range(n):
        rows = (items if n == 1 else items.where(part == i)).collect()
        yield Block.of(sorted(((r["item_id"], r["text"]) for r in rows),
                              key=lambda i: (i[0] is not None, i[0] or 0, i[1])))


OVERLAPS = "array<struct<item_id:bigint,start:int,end:int,n_equal:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()),
                             ("end", pa.int32()), ("n_equal", pa.int32())]))


def _search(texts: DataFrame, names: list[str], block: Block) -> DataFrame:
    """Columns `names` of `texts` and the overlaps of its last column with one block."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[dict(zip(("item_id", "start", "end", "n_equal"), x))
                     for x in shared.value.search(t.as_py())]
                    for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(hits, _ARROW)], [*names, "overlaps"])

    schema = texts.select(*names, F.array().cast(OVERLAPS).alias("overlaps")).schema
    return texts.mapInArrow(searched, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without its text, with `overlaps`: (item_id, start, end, n_equal), ordered.

    An item has one overlap with a text at most, the one with most equal words, of several the
    first. `start` and `end` are words of the document, numbered from 0. Null and empty texts
    and items have no words and no overlaps; an item shorter than `MIN_EQUAL` words must stand
    there in full, one shorter than `MIN_WORDS` must be the whole text. Items without an id are items of their own, reported with a null id; items
    that repeat an id with another text are each reported. Rows are searched each on their own,
    whatever their length. An empty table of documents gives no rows. A column of `docs` called
    overlaps is replaced. Blocks of items are a pass each; their few hits are joined back by the
    texts' digest, with the same result for any number of blocks.
    """
    names = [c for c in docs.columns if c not in ("text", "overlaps")]
    texts = docs.select(*(docs[c] for c in names), docs["text"].alias("_text"))
    blocks = blocks_of(benchmark, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return texts.drop("_text").withColumn("overlaps", F.array().cast(OVERLAPS))
    if second is None:
        return _search(texts, names, first)
    digest = F.md5("_text")
    hits = None
    for block in (first, second, *blocks):
        found = stored(_search(texts.select(digest.alias("_digest"), "_text"), ["_digest"], block)
                       .where("size(overlaps) > 0").distinct(), "benchmark-hits")
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy("_digest").agg(
        F.sort_array(F.flatten(F.collect_list("overlaps"))).alias("overlaps"))
    return (texts.withColumn("_digest", digest).drop("_text").join(hits, "_digest", "left")
            .select(*names, F.coalesce("overlaps", F.array().cast(OVERLAPS)).alias("overlaps")))


def clean(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` without an overlap, all columns as they were."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"])
    return (find_overlaps(rows, benchmark, **options)
            .where("size(overlaps) = 0").select("row.*"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document: verdict, items and longest overlap."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = F.array_sort(F.array_distinct("overlaps.item_id"))
    return find_overlaps(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"), items.alias("item_ids"),
        F.coalesce(F.array_max("overlaps.n_equal"), F.lit(0)).cast("long").alias("most_equal"))
