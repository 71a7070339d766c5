"""Quality rules: a calibrated classifier on hashed n-grams, next to fixed base rules.

Features of a text are the shares of its hashed words, word pairs and character trigrams. A
logistic regression is fitted on labelled rows and its margin is calibrated by a second, one-
variable regression on labelled rows that the first has not seen. Scoring runs in Arrow
batches; a text is kept when no base rule fails and its calibrated probability of being good
reaches a fixed threshold.

The fit uses at most `fit_rows` labelled rows, those whose ids hash lowest: a bounded sample,
the one part that does not grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import stored, table

WORD_BITS, GRAM_BITS = 13, 14
SIZE = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: Most labelled rows used to fit; one in `CALIBRATE` of them is for calibration.
FIT_ROWS, CALIBRATE = 4000, 4
THRESHOLD = 0.5
#: Rows of each class below which there is nothing to fit on.
MIN_CLASS = 5
RIDGE, ROUNDS = 1e-7, 60
#: Characters that count as symbols, window length of repeats.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPACES = b" \t\n\x0b\x0c\r"
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Model:
    """Coefficients per feature, intercept, and the two calibration numbers."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number by first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that stand twice or more in the text.

    Windows are compared exactly: numbers of runs of 2, 4 and 8 words are built from pairs
    of numbers of runs half as long.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    runs, length = ids, 1
    while length < window:
        pair = runs[:len(runs) - length] * (int(runs.max()) + 1) + runs[length:]
        runs = np.unique(pair, return_inverse=True)[1]
        length *= 2
    twice = np.bincount(runs)[runs] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += twice
    edges[window:window + n] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def base_counts(text: str, data: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ids))


def _hashed_words(ids: np.ndarray, distinct: list[bytes]) -> Iterator[np.ndarray]:
    """Features of single words and of word pairs."""
    if not distinct:
        return
    codes = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[ids]
    yield ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[1:]
    yield ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _hashed_grams(data: bytes) -> Iterator[np.ndarray]:
    """Features of byte trigrams, in blocks, so that a very long text needs little memory."""
    for start in range(0, max(0, len(data) - 2), _BLOCK):
        raw = np.frombuffer(data, np.uint8)[start:start + _BLOCK + 2].astype(np.uint32)
        code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        yield (((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
               + (1 << WORD_BITS))


def features(data: bytes, ids: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their shares: words and trigrams have a total of 1 each."""
    dense = np.zeros(SIZE)
    for part in (_hashed_words(ids, distinct), _hashed_grams(data)):
        blocks = list(part)
        n = sum(map(len, blocks))
        for block in blocks:
            dense += np.bincount(block, minlength=SIZE) / n
    at = np.flatnonzero(dense)
    return at, dense[at]


def margin(model: Model, data: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
    """The model's margin of a text, without building its feature vector."""
    total = model.intercept
    for part in (_hashed_words(ids, distinct), _hashed_grams(data)):
        n, s = 0, 0.0
        for block in part:
            n += len(block)
            s += float(model.weights[block].sum())
        total += s / n if n else 0.0
    return total


def _descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray,
             rounds: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    x, (value, slope), past = start, loss(start), []
    for _ in range(rounds):
        step, kept = -slope, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            step = step - a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            step = step + (a - y @ step / (s @ y)) * s
        size = 1.0 if past else 1.0 / max(1e-12, float(np.abs(slope).sum()))
        while size > 1e-10:
            new = x + size * step
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-18:
            past = [*past[-9:], (s, y)]
        done = value - new_value < 1e-9 * abs(value)
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray,
                 ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept; both classes weigh the same."""
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    sign = np.where(good, 1.0, -1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (np.bincount(row, value * x[at], len(rows)) + x[SIZE])
        pull = -share * sign / (1 + np.exp(np.clip(z, -30, 30)))
        slope = np.empty(SIZE + 1)
        slope[:SIZE] = np.bincount(at, value * pull[row], SIZE) + 2 * ridge * x[:SIZE]
        slope[SIZE] = pull.sum()
        return float(share @ np.logaddexp(0, -z) + ridge * x[:SIZE] @ x[:SIZE]), slope

    x = _descend(loss, np.zeros(SIZE + 1), rounds)
    return x[:SIZE], float(x[SIZE])


def fit_calibration(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Platt scaling).

    Targets are pulled in by one pseudo-row per class, so that classes the margin separates
    without error still give finite numbers.
    """
    n_good, n_bad = int(good.sum()), int((~good).sum())
    if not n_good or not n_bad:
        return 1.0, 0.0
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[0] * margins + x[1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        return (float(np.mean(np.logaddexp(0, z) - target * z)),
                np.array([np.mean(gap * margins), np.mean(gap)]))

    slope, offset = _descend(loss, np.array([1.0, 0.0]), 200)
    return float(slope), float(offset)


def _prepared(text: str | None) -> tuple[str, bytes, list[bytes], np.ndarray, list[bytes]]:
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    ids, distinct = _word_ids(words)
    return text, data, words, ids, distinct


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The calibrated model, or None when either class has fewer than `MIN_CLASS` rows.

    Labels without a quality and ids without a text do not count; an id with several labels
    or texts counts once per pair. Only features of at most `fit_rows` rows reach the driver.
    """
    order = F.xxhash64("doc_id", F.lit(1))
    chosen = stored(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
                    .select("doc_id", F.col("quality").cast("int").alias("quality"))
                    .orderBy(order, "doc_id", "quality").limit(fit_rows), "quality-labels")
    # Rows that repeat an id are bounded, too, before any text is read in Python.
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(
        F.xxhash64("doc_id", "quality", "text"), "doc_id", "quality").limit(fit_rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for text in batch.column(1):
                _, data, _, ids, distinct = _prepared(text.as_py())
                a, v = features(data, ids, distinct)
                at.append(a.astype("<u2").tobytes())
                value.append(v.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(at, pa.binary()),
                 pa.array(value, pa.binary())], ["doc_id", "quality", "at", "value"])

    found = sorted((texts.select("doc_id", "text", "quality").mapInArrow(
        made, "doc_id long, quality int, at binary, value binary").collect()),
        key=lambda r: (r["doc_id"], r["quality"], r["at"], r["value"]))[:fit_rows]
    good = np.array([r["quality"] == 1 for r in found], bool)
    apart = np.array([zlib.crc32(str(r["doc_id"]).encode()) % CALIBRATE == 0 for r in found],
                     bool)
    rows = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["value"], "<f4")) for r in found]
    del found
    if min(good.sum(), (~good).sum()) < MIN_CLASS or not (~apart).any():
        return None
    train = [i for i in range(len(rows)) if not apart[i]]
    weights, intercept = fit_logistic([rows[i] for i in train], good[train])
    held = [i for i in range(len(rows)) if apart[i]] or train
    margins = np.array([weights[rows[i][0]] @ rows[i][1] + intercept for i in held])
    slope, offset = fit_calibration(margins, good[held])
    return Model(weights.astype(np.float32), intercept, slope, offset)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without its text, with the base counts, base_failed, p_good and kept.

    A null or empty text has no words and fails the base rule. Without a model p_good is null
    and the base rules decide alone. Every row is judged on its own and whole, at any length.
    An empty table gives no rows. Columns of `docs` with these names are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "p_good", "kept"]
    names = [c for c in docs.columns if c != "text" and c not in new]
    texts = docs.select(*(docs[c] for c in names), docs["text"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, margins = [], []
            for value in batch.column(len(names)):
                text, data, words, ids, distinct = _prepared(value.as_py())
                counts.append(base_counts(text, data, words, ids))
                if model is not None:
                    margins.append(margin(model, data, ids, distinct))
            table_ = np.array(counts, np.int64).reshape(-1, 5)
            failed = (table_[:, 0] < 20) | (100 * table_[:, 4] > 30 * table_[:, 0])
            if model is None:
                p = pa.nulls(len(counts), pa.float64())
                kept = ~failed
            else:
                good = model.probability(np.array(margins))
                p, kept = pa.array(good), ~failed & (good >= threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], *(pa.array(table_[:, i]) for i in range(5)),
                 pa.array(failed), p, pa.array(kept)], [*names, *new])

    schema = texts.select(*names).schema
    for name in new:
        schema = schema.add(name, {"base_failed": "boolean", "kept": "boolean",
                                   "p_good": "double"}.get(name, "long"))
    return texts.mapInArrow(scored, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, all columns as they were."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"])
    return score(rows, fit(docs, labels)).where("kept").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model)
