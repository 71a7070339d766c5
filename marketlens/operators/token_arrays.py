"""Counts over the words of an Arrow batch with NumPy: no Python object per word or n-gram.

Every distinct word of a batch gets a number; n-grams are pairs of a shorter n-gram's number and
a word's, and counting is a sort of such numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: About as many words are looked at, and about as many n-grams per size held, at a time.
PART_WORDS = 1 << 18


class Words(NamedTuple):
    """The words of a few rows, in order: the row of each and its place in `known`."""

    row: np.ndarray
    code: np.ndarray
    known: pa.StringArray


#: The words of n rows to (row, place, value) of their vectors' entries, in ascending order.
Maker = Callable[[Words, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def words_of(lists: pa.ListArray) -> Words:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return Words(np.repeat(np.arange(len(lists)), lengths),
                 coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def parts(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `PART_WORDS` words each in a column."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        seen = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, seen + PART_WORDS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def count_pairs(row: np.ndarray, item: np.ndarray, size: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, item) in ascending order, and how often each occurs; items are < size."""
    key, n = np.unique(row * size + item, return_counts=True)
    return key // max(size, 1), key % max(size, 1), n


def grams(words: Words, low: int, high: int
          ) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StringArray]]:
    """(row, gram, texts) for each size: every n-gram as its row and its place in `texts`."""
    row, code, known = words
    at, gram, texts = np.arange(len(code)), code, known
    for size in range(1, high + 1):
        if size > 1:
            # An n-gram ends in the row where it begins.
            inside = at + size - 1 < len(code)
            inside[inside] = row[at[inside] + size - 1] == row[at[inside]]
            at = at[inside]
            pair, gram = np.unique(gram[inside] * len(known) + code[at + size - 1],
                                   return_inverse=True)
            texts = pc.binary_join_element_wise(
                texts.take(pa.array(pair // max(len(known), 1))),
                known.take(pa.array(pair % max(len(known), 1))), " ")
        if size >= low:
            yield row[at], gram, texts


class TermIndex:
    """Finds the terms, each of `low` to `high` words, among all n-grams of some words.

    The terms form a tree of words; one sorted table holds its edges (node, word) -> node.
    """

    def __init__(self, terms: Sequence[str], low: int, high: int):
        self.words, edges, ends = {}, {}, {}
        for place, term in enumerate(terms):
            cut, node = term.split(" "), 0
            if low <= len(cut) <= high:
                for word in cut:
                    step = node, self.words.setdefault(word, len(self.words))
                    node = edges.setdefault(step, len(edges) + 1)
                ends[node] = place
        self.high = high
        keys = np.array([node * len(self.words) + word for node, word in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.places = np.full(len(edges) + 1, -1)
        self.places[list(ends)] = list(ends.values())

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the term) of every occurrence."""
        own = np.array([self.words.get(w, -1) for w in words.known.to_pylist()], np.int64)
        code = own[words.code]
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        rows, places = [], []
        for size in range(self.high if len(self.keys) else 0):
            inside = at + size < len(code)
            last = at[inside] + size
            inside[inside] = (words.row[last] == words.row[at[inside]]) & (code[last] >= 0)
            at, node = at[inside], node[inside]
            key = node * len(self.words) + code[at + size]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            at, node = at[hit], self.nodes[edge[hit]]
            place = self.places[node]
            rows.append(words.row[at[place >= 0]])
            places.append(place[place >= 0])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *places])


def unit_length(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Values divided by the Euclidean length of their row's; zeros stay."""
    length = np.sqrt(np.bincount(row, value * value, minlength=n))[row]
    return np.divide(value, length, out=np.zeros(len(value)), where=length != 0)


def term_weights(terms: Sequence[str], idf: Sequence[float], low: int, high: int) -> Maker:
    """Unit-length (1 + ln n) * idf of the terms among a row's n-grams."""
    index, factor = TermIndex(terms, low, high), np.array(idf, float)

    def made(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place, count = count_pairs(*index.found(words), len(factor))
        return row, place, unit_length(row, (1 + np.log(count)) * factor[place], n)

    return made


def bucket(word: str, size: int) -> int:
    """Bucket of a word by the first 32 bits of its md5, as in `embedding.hashed_counts`."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4]) % size


def bucket_weights(size: int) -> Maker:
    """Words counted in `size` buckets, at unit length."""
    def made(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array([bucket(w, size) for w in words.known.to_pylist()], np.int64)
        row, place, count = count_pairs(words.row, own[words.code], size)
        return row, place, unit_length(row, count.astype(float), n)

    return made


_ENTRIES = [pa.list_(pa.field("element", kind, False)) for kind in (pa.int32(), pa.float64())]
_VECTOR = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
           pa.field("indices", _ENTRIES[0]), pa.field("values", _ENTRIES[1])]


def _vectors(lists: pa.ListArray, make: Maker, size: int) -> pa.StructArray:
    """A sparse vector per list of words, laid out as Spark stores it."""
    n = len(lists)
    row, place, value = make(words_of(lists), n)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    entries = [pa.ListArray.from_arrays(ends, pa.array(x, kind.value_type), type=kind)
               for x, kind in zip((place, value), _ENTRIES)]
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *entries],
        fields=_VECTOR)


def append_columns(df: DataFrame, inputs: Sequence[Column], fields: Sequence[T.StructField],
                   make: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """Append columns made from those of `inputs`, of which the first holds lists of words, by
    one Arrow function; nothing is shuffled."""
    names = {field.name for field in fields}
    kept = df.select(*[c for c in df.columns if c not in names])
    schema, n = T.StructType([*kept.schema.fields, *fields]), len(kept.columns)

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, n):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], *make(part.columns[n:])], schema.names)

    given = [column.alias(f"_given_{k}") for k, column in enumerate(inputs)]
    return df.select(*kept.columns, *given).mapInArrow(appended, schema)


def append_vectors(df: DataFrame, makers: Mapping[str, tuple[Column, Maker, int]]) -> DataFrame:
    """Append sparse vectors, given as {name: (array of words, maker, length)}."""
    made = [(make, size) for _, make, size in makers.values()]
    return append_columns(
        df, [words for words, _, _ in makers.values()],
        [T.StructField(c, VectorUDT()) for c in makers],
        lambda lists: [_vectors(one, *each) for one, each in zip(lists, made)])
