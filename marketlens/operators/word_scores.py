"""Lexicon and valence sums of the words of an Arrow batch with NumPy.

The rules are those of `functions.lexicon`; every distinct word of a batch is looked up once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.lexicon import (
    AFTER_BUT, BEFORE_BUT, BOOST, CAPITALS, DAMPING, EDGE_PUNCTUATION, NEGATION_FACTOR)
from marketlens.functions.text import null_text_to_empty, split_words
from marketlens.lexicons import DAMPENERS, DEFAULT_VALENCE, INTENSIFIERS, NEGATIONS, Lexicon
from marketlens.operators.lexicon_scan import CLASSES
from marketlens.operators.token_arrays import Words, append_columns, count_pairs, words_of

_EDGES = re.compile(EDGE_PUNCTUATION)
_SPACE = re.compile("[\t-\r\x1c-\x1f ]")
SUMS = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("polarity", "subjectivity")],
    *[T.StructField(c, T.IntegerType()) for c in ("hits", *CLASSES)],
    *[T.StructField(c, T.DoubleType()) for c in ("all", "pos", "neg")],
    *[T.StructField(c, T.IntegerType()) for c in ("n", "words")]])


def weight_sums(words: Words, n: int, weights: dict[str, tuple[float, float]]) -> list[np.ndarray]:
    """Per row the sums of both weights over the words that have them, and their number."""
    own = [weights.get(w.lower()) for w in words.known.to_pylist()]
    has = np.array([w is not None for w in own], bool)[words.code]
    row, code = words.row[has], words.code[has]
    each = np.array([w or (0.0, 0.0) for w in own], float).reshape(-1, 2)[code]
    return [np.bincount(row, each[:, 0], n), np.bincount(row, each[:, 1], n),
            np.bincount(row, minlength=n)]


def contained(words: Words, text: pa.StringArray, terms: list[str]
              ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) with the term anywhere in the lower-cased text. A term without white
    space lies within a word; others are searched in the text."""
    known, place, term = [w.lower() for w in words.known.to_pylist()], [], []
    rows, found = [], []
    for j, t in enumerate(terms):
        if t and not _SPACE.search(t):
            held = [i for i, w in enumerate(known) if t in w]
            place += held
            term += [j] * len(held)
        else:
            rows.append(np.flatnonzero(pc.match_substring(text, t).to_numpy(zero_copy_only=False)))
            found.append(np.full(len(rows[-1]), j))
    order = np.argsort(place, kind="stable")
    place, term = np.array(place, np.int64)[order], np.array(term, np.int64)[order]
    times = np.bincount(place, minlength=len(known))
    first = np.concatenate([[0], np.cumsum(times)])
    has = times[words.code] > 0
    row, code = words.row[has], words.code[has]
    n = times[code]
    # The terms of a word stand next to each other, from its `first` on.
    at = np.repeat(first[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
    row, item, _ = count_pairs(np.concatenate([*rows, np.repeat(row, n)]).astype(np.int64),
                               np.concatenate([*found, term[at]]).astype(np.int64), len(terms))
    return row, item


def valence_sums(words: Words, n: int, valence: dict[str, float]) -> list[np.ndarray]:
    """Per row the tally of `functions.lexicon.valence_scores` and the number of words."""
    known = [_EDGES.sub("", w.replace("'", "").replace("’", "")) for w in words.known.to_pylist()]
    lower = [w.lower() for w in known]
    modifiers = {**{w: BOOST for w in INTENSIFIERS}, **{w: -BOOST for w in DAMPENERS}}
    negations = set(NEGATIONS)
    kept = np.array([w != "" for w in known], bool)[words.code]
    row, code = words.row[kept], words.code[kept]
    v, b = (np.array([float(table.get(w, 0.0)) for w in lower], float)[code]
            for table in (valence, modifiers))
    negates = np.array([w in negations for w in lower], bool)[code]
    upper = np.array([small != w and w.upper() == w for small, w in zip(lower, known)], bool)[code]
    but = np.flatnonzero(np.array([w == "but" for w in lower], bool)[code])
    # Capitals stress only if some word of the row is plain.
    stressed = upper & (np.bincount(row[~upper], minlength=n) > 0)[row]
    v = np.where(stressed & (v != 0), v + np.copysign(CAPITALS, v), v)
    b = np.where(stressed & (b != 0), b + CAPITALS, b)
    hit = np.flatnonzero(v)
    own = row[hit]
    sign, total, negated = np.where(v[hit] < 0, -1.0, 1.0), v[hit], np.zeros(len(hit), bool)
    for distance, factor in enumerate(DAMPING, start=1):
        earlier = np.maximum(hit - distance, 0)
        same = (hit >= distance) & (row[earlier] == own)
        total = total + np.where(same, sign * b[earlier] * factor, 0.0)
        negated |= same & negates[earlier]
    total = np.where(negated, total * NEGATION_FACTOR, total)
    first = np.full(n, len(row))
    np.minimum.at(first, row[but], but)
    contrast = first[own]
    has = contrast < len(row)
    total = np.where(has & (hit < contrast), total * BEFORE_BUT,
                     np.where(has & (hit > contrast), total * AFTER_BUT, total))
    up, down = total > 0, total < 0
    return [np.bincount(own, total, n), np.bincount(own[up], total[up] + 1, n),
            np.bincount(own[down], total[down] - 1, n),
            np.bincount(own[total != 0], minlength=n), np.bincount(row, minlength=n)]


def append_sums(df: DataFrame, text: str, output: str, lexicon: Lexicon,
                valence: dict[str, float] = DEFAULT_VALENCE) -> DataFrame:
    """Append a struct of `SUMS` over the words of a text; nothing is shuffled."""
    weights = lexicon.weights()
    terms = sorted({term for term, *_ in lexicon.rows})
    of_class = [np.isin(terms, lexicon.terms(c)) for c in CLASSES]

    def made(given: list[pa.Array]) -> list[pa.Array]:
        words, n = words_of(given[0]), len(given[0])
        row, term = contained(words, given[1], terms)
        counts = [np.bincount(row[member[term]], minlength=n) for member in of_class]
        sums = [*weight_sums(words, n, weights), *counts, *valence_sums(words, n, valence)]
        arrays = [pa.array(x, pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32())
                  for x, f in zip(sums, SUMS)]
        return [pa.StructArray.from_arrays(arrays, SUMS.names)]

    given = null_text_to_empty(text)
    return append_columns(df, [split_words(given), F.lower(given)],
                          [T.StructField(output, SUMS)], made)
