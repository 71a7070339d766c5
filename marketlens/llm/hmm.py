"""Hidden Markov language model over word classes, with exact sequence likelihoods.

A word belongs to a class, by hash; a class is what a hidden state emits. Inside its class a
word has its smoothed share of all training tokens of the class, so the vocabulary is as large
as the corpus and no part of it is kept by any one process:

    P(text) = P(class sequence | states) * product of P(word | class)

Documents are stored once as blocks: the distinct words of a block, and each document as
numbers into them. Word counts are summed over the blocks' words and come back to each block as
one number per word. Baum-Welch runs on the blocks: every task returns expected counts, whose
size the model bounds, and their sums give the next model. Scoring is the forward recursion,
scaled at each step, over whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stored, table

STATES, CLASSES, ROUNDS, SEED = 4, 2048, 5, 17
#: Bytes of text in one block. A longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Added to every expected start and move, and to each state's emissions in all, there in
#: proportion to the corpus: no step of a sequence is impossible.
PRIOR = 0.5


def class_shares(class_counts: np.ndarray) -> np.ndarray:
    """Smoothed share of each class in the training tokens."""
    return (class_counts + PRIOR) / (class_counts + PRIOR).sum()


@dataclass(frozen=True)
class Model:
    """First state, next state and emitted class probabilities; the last class ends a text."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """Corpus-wide class shares, shaken per state so that states can part."""
        rng = np.random.default_rng(seed)
        emit = shares * rng.uniform(0.5, 1.5, (states, len(shares)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray, states: int, shares: np.ndarray) -> Model:
        start = counts[:states] + PRIOR
        move = counts[states:states + states * states].reshape(states, states) + PRIOR
        emit = counts[states + states * states:].reshape(states, -1) + PRIOR * shares
        return cls(start / start.sum(), move / move.sum(1, keepdims=True),
                   emit / emit.sum(1, keepdims=True))


def _steps(symbols: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Symbols of all sequences that are long enough, step by step; longest sequence first."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, ends = starts[order], -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        yield symbols[starts[:np.searchsorted(ends, -t)] + t]


def log_likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence; `symbols` holds them one after another."""
    total = np.zeros(len(lengths))
    ahead = None
    for symbol in _steps(symbols, lengths):
        n = len(symbol)
        ahead = (model.start[:, None] if ahead is None else model.move.T @ ahead[:, :n])
        ahead = ahead * model.emit[:, symbol]
        scale = ahead.sum(0)
        ahead /= scale
        total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[np.argsort(-lengths, kind="stable")] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of starts, moves and emissions, in one array, over all sequences."""
    states, classes = model.emit.shape
    steps = list(_steps(symbols, lengths))
    if not steps:
        return np.zeros(states + states * states + states * classes)
    aheads, scales = [], []
    for symbol in steps:
        ahead = (model.start[:, None] if not aheads else model.move.T @ aheads[-1][:, :len(symbol)])
        ahead = ahead * model.emit[:, symbol]
        scales.append(ahead.sum(0))
        aheads.append(ahead / scales[-1])
    moves = np.zeros((states, states))
    back = np.ones((states, len(steps[-1])))
    for t in range(len(steps) - 1, 0, -1):
        pull = model.emit[:, steps[t]] * back / scales[t]
        moves += aheads[t - 1][:, :pull.shape[1]] @ pull.T
        aheads[t] *= back
        back = np.ones((states, len(steps[t - 1])))
        back[:, :pull.shape[1]] = model.move @ pull
    aheads[0] *= back
    symbol, weight = np.concatenate(steps), np.concatenate(aheads, axis=1)
    emit = [np.bincount(symbol, w, classes) for w in weight]
    return np.concatenate([aheads[0].sum(1), (moves * model.move).ravel(), *emit])


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word) % classes


def make_blocks(docs: DataFrame, classes: int = CLASSES,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of `docs` (doc_id, text, held_out).

    doc_ids, held, lengths: the documents; ids: their tokens one after another, as 32-bit
    numbers into words; words, counts, symbols: each distinct word, how often it stands in
    training documents, its class. A text's last token is its end, written as the empty word.
    """
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        doc_ids, held, lengths, parts, size = [], [], [], [], 0
        seen: dict[bytes, int] = {b"": 0}

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            words = list(seen)
            train = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(ids[train], minlength=len(words))
            symbols = np.fromiter((word_class(w, classes) for w in words), "<u2", len(words))
            symbols[0] = classes
            row = {"block": first + made, "doc_ids": doc_ids, "held": held, "lengths": lengths,
                   "ids": ids.astype("<u4").tobytes(), "words": words, "counts": counts,
                   "symbols": symbols.tobytes()}
            kinds = {"doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()),
                     "lengths": pa.list_(pa.int64()), "words": pa.list_(pa.binary()),
                     "counts": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kinds.get(k)) for k, v in row.items()], list(row))

        for batch in batches:
            for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                # ASCII letters and white space only, as bytes' methods have it.
                words = (text or "").encode("utf-8").lower().split()
                ids = [seen.setdefault(w, len(seen)) for w in words]
                parts.append(np.array([*ids, 0], np.int64))
                doc_ids.append(doc_id)
                held.append(out)
                lengths.append(len(ids) + 1)
                size += len(text or "") + 16
                if size >= block_bytes:
                    yield block()
                    made += 1
                    doc_ids, held, lengths, parts, size = [], [], [], [], 0
                    seen = {b"": 0}
        if parts:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(
        blocked, "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, "
        "ids binary, words array<binary>, counts array<long>, symbols binary")


def count_words(blocks: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(block, pos, c, symbol, n, new): corpus count of each word of each block.

    `new` marks one row per distinct word. A word has one row per block at most.
    """
    whole = Window.partitionBy("word")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias(
        "pos", "w")).select("block", "pos", F.col("w.words").alias("word"),
                            F.col("w.counts").alias("n"))
    symbol = F.when(F.length("word") == 0, F.lit(classes)).otherwise(
        F.pmod(F.crc32("word"), F.lit(classes))).cast("int")
    return listed.select("block", "pos", F.sum("n").over(whole).alias("c"), symbol.alias("symbol"),
                         "n", (F.min("block").over(whole) == F.col("block")).alias("new"))


def _part(blocks: pa.Table | pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    """ids, symbols of words, lengths and held of one block."""
    get = {n: blocks.column(n)[row] for n in ("ids", "symbols", "lengths", "held")}
    return (np.frombuffer(get["ids"].as_py(), "<u4"),
            np.frombuffer(get["symbols"].as_py(), "<u2").astype(np.int64),
            get["lengths"].values.to_numpy(), get["held"].values.to_numpy(zero_copy_only=False))


def train(blocks: DataFrame, class_counts: np.ndarray, states: int = STATES,
          rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Baum-Welch over the training documents of all blocks."""
    shares = class_shares(class_counts)
    model = Model.first(shares, states, seed)
    read = blocks.select("ids", "symbols", "lengths", "held")
    for _ in range(rounds):
        def summed(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, symbols, lengths, held = _part(batch, row)
                    chosen = symbols[ids[np.repeat(~held, lengths)]]
                    total = total + expected_counts(model, chosen, lengths[~held])
            if isinstance(total, np.ndarray):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(total[at])], ["at", "value"])

        counts = np.zeros(states + states * states + model.emit.size)
        for r in (read.mapInArrow(summed, "at int, value double").groupBy("at")
                  .agg(F.sum("value").alias("value")).collect()):
            counts[r["at"]] = r["value"]
        model = Model.of_counts(counts, states, shares)
    return model


def score_corpus(docs: DataFrame, states: int = STATES, classes: int = CLASSES,
                 rounds: int = ROUNDS, seed: int = SEED,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text, held_out), learnt from rows not held out.

    base_score is the smoothed unigram model's log10 probability of the text, score the hidden
    Markov model's. Null and empty texts are their end token alone. Ids may be null or repeat;
    repeated rows count and are scored each. Without training rows every word is as likely
    inside its class, and the first model scores. Columns beyond these three are not read.
    """
    blocks = stored(make_blocks(docs, classes, block_bytes), "hmm-blocks", compression="zstd")
    counted = stored(count_words(blocks, classes), "hmm-counts", compression="zstd")
    tokens, distinct = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in counted.groupBy("symbol").agg(
            F.sum("n").alias("n"), F.count_if(F.col("new") & (F.col("c") > 0)).alias("v")).collect():
        tokens[r["symbol"]], distinct[r["symbol"]] = r["n"], r["v"]
    model = train(blocks, tokens, states, rounds, seed)
    n, v = int(tokens.sum()), int(distinct.sum())
    # The end of a text is alone in its class.
    class_mass = tokens + 0.5 * (distinct + 1)

    def scored(block: pa.Table, counts: pa.Table) -> pa.Table:
        ids, symbols, lengths, held = _part(block, 0)
        c = np.zeros(len(symbols))
        c[counts["pos"].to_numpy()] = counts["c"].to_numpy()
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        inner = np.where(symbols == classes, 0.0, np.log10((c + 0.5) / class_mass[symbols]))
        starts = np.cumsum(lengths) - lengths
        chain = log_likelihoods(model, symbols[ids], lengths) / np.log(10)
        return pa.table({
            "doc_id": block["doc_ids"].chunk(0).values, "held_out": held, "n_tokens": lengths,
            "n_known": np.add.reduceat((c > 0)[ids].astype(np.int64), starts),
            "train_tokens": np.full(len(lengths), n),
            "base_score": np.add.reduceat(base[ids], starts),
            "score": chain + np.add.reduceat(inner[ids], starts)})

    return (blocks.drop("words", "counts").groupBy("block")
            .cogroup(counted.select("block", "pos", "c").groupBy("block"))
            .applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                          "train_tokens long, base_score double, score double"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; one in five documents is not learnt from."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score_corpus(table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")))
