"""Lexicons and vocabularies of any size, given as tables.

A lexicon is dealt by term hash into blocks of bounded bytes. Every block is compiled into a
multi-pattern automaton that finds all of its terms in one walk over a text, whatever their
number, and all classes at once. Blocks are broadcast one by one and the rows pass them one
after another inside the same stage, each adding to the row's running counts; texts are never
shuffled, and neither driver nor worker holds more than a block of an arbitrarily large table.
Most lexicons are one block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import null_text_to_empty
from marketlens.lexicons import NOUN_SUFFIXES, Lexicon

#: Bytes of terms in a block, with what a term costs besides its letters.
BLOCK_BYTES, TERM_BYTES = 32 << 20, 64
CLASSES = ("bullish", "bearish", "neutral")
# The white space that `functions.text.split_words` cuts at.
_SPACES = re.compile("[\t-\r\x1c-\x1f ]+")

#: Rows of (term, ...) of one block to what the worker keeps of them.
Compiler = Callable[[list[tuple]], object]
_compiled: dict[Compiler, tuple[list[tuple], object]] = {}


#: Rows that a worker has in Python objects, and in the making, at a time.
PART_ROWS = 512


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(start, PART_ROWS)


def _held(block: Broadcast, compiler: Compiler):
    """The compiled block. A worker keeps the last one of each kind."""
    rows = block.value
    if _compiled.get(compiler, (None,))[0] is not rows:
        _compiled[compiler] = rows, compiler(rows)
    return _compiled[compiler][1]


def term_blocks(table: DataFrame, columns: Sequence[str], block_bytes: int = BLOCK_BYTES
                ) -> Iterator[Broadcast]:
    """Broadcasts of the table's rows, all rows of a term in one; null terms are left out."""
    rows = table.select(*columns).where(F.col(columns[0]).isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length(columns[0]) + TERM_BYTES)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(columns[0]), F.lit(n)))
    if n > 1:
        dealt = dealt.repartition("_block").persist()
    try:
        for b in range(n):
            part = dealt.where(F.col("_block") == b).drop("_block")
            yield table.sparkSession.sparkContext.broadcast(sorted(
                (tuple(r) for r in part.collect()), key=lambda r: [str(v) for v in r]))
    finally:
        if n > 1:
            dealt.unpersist()


class Matcher:
    """One block of lexicon rows (term, class, polarity, subjectivity)."""

    def __init__(self, rows: list[tuple]) -> None:
        self.terms = sorted({r[0] for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        classes: list[set] = [set() for _ in self.terms]
        self.weights: dict[str, tuple[float, float]] = {}
        for term, label, polarity, subjectivity in rows:
            classes[number[term]].add(label)
            # The first class in sort order gives a term its weights.
            self.weights.setdefault(term, (polarity, subjectivity))
        self.classes = [tuple(sorted(c for c in own if c is not None)) for own in classes]
        self.number = number
        self.automaton = ahocorasick.Automaton()
        for term, i in number.items():
            if term:
                self.automaton.add_word(term, i)
        self.automaton.make_automaton()

    def contained(self, text: str) -> set[int]:
        """Numbers of the terms that are substrings; the empty term is one of every text."""
        found = {0} if self.terms[:1] == [""] else set()
        if len(self.automaton):
            found.update(i for _, i in self.automaton.iter(text))
        return found


def _lexicon_table(lexicon: DataFrame | Lexicon, df: DataFrame) -> DataFrame:
    return lexicon.table(df.sparkSession) if isinstance(lexicon, Lexicon) else lexicon


def scan(df: DataFrame, text: Column | str, lexicon: DataFrame | Lexicon, *,
         token_text: Column | str | None = None, classes: Sequence[str] = CLASSES,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append lexicon counts of every row, found in one walk over its text per block of terms.

    `{class}_count`: distinct terms of the class that are substrings of the lower-cased text.
    `{class}_tokens`: distinct white-space tokens of the lower-cased `token_text` (the same
    text by default) that are terms. `polarity` and `subjectivity`: mean weights of the tokens
    that are terms, repeats included; 0 without one. Null texts are empty.
    """
    given = df.columns
    n, k = len(given), len(classes)
    place = {c: i for i, c in enumerate(classes)}
    # A text that serves for both goes to the worker once.
    texts = {"_text": F.lower(null_text_to_empty(text))}
    if token_text is not None:
        texts["_words"] = F.lower(null_text_to_empty(token_text))
    last = n + len(texts) - 1
    out = df.withColumns({
        **texts, "_seen": F.array(*[F.lit(0)] * (2 * k)), "_sums": F.array(*[F.lit(0.0)] * 3)})
    out = out.select(*given, *texts, "_seen", "_sums")
    schema = out.schema
    for block in term_blocks(_lexicon_table(lexicon, df), list(Lexicon.SCHEMA.names), block_bytes):
        def counted(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _held(block, Matcher)
            for batch in _parts(batches):
                seen = batch.column(last + 1).to_pylist()
                sums = batch.column(last + 2).to_pylist()
                for row, (body, words) in enumerate(zip(batch.column(n), batch.column(last))):
                    for i in matcher.contained(body.as_py()):
                        for c in matcher.classes[i]:
                            if c in place:
                                seen[row][place[c]] += 1
                    hits = [w for w in _SPACES.split(words.as_py()) if w and w in matcher.weights]
                    for w in set(hits):
                        for c in matcher.classes[matcher.number[w]]:
                            if c in place:
                                seen[row][k + place[c]] += 1
                    for w in hits:
                        polarity, subjectivity = matcher.weights[w]
                        sums[row][0] += polarity
                        sums[row][1] += subjectivity
                        sums[row][2] += 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:last + 1], pa.array(seen, pa.list_(pa.int32())),
                     pa.array(sums, pa.list_(pa.float64()))], batch.schema.names)

        out = out.mapInArrow(counted, schema)
    mean = [F.coalesce(F.try_divide(F.get("_sums", F.lit(i)), F.get("_sums", F.lit(2))),
                       F.lit(0.0)) for i in (0, 1)]
    return out.select(
        *given, *[F.get("_seen", F.lit(i)).alias(f"{c}_count") for i, c in enumerate(classes)],
        *[F.get("_seen", F.lit(k + i)).alias(f"{c}_tokens") for i, c in enumerate(classes)],
        mean[0].alias("polarity"), mean[1].alias("subjectivity"))


class Terms(Matcher):
    """One block of bare terms."""

    def __init__(self, rows: list[tuple]) -> None:
        super().__init__([(term, None, 0.0, 0.0) for term, *_ in rows])


def contained_terms(df: DataFrame, text: Column | str, terms: DataFrame,
                    output: str = "terms", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append the sorted array of all entries of `terms` (term) that are substrings of the
    lower-cased text."""
    given = df.columns
    n = len(given)
    out = df.select(*given, F.lower(null_text_to_empty(text)).alias("_text"),
                    F.array().cast("array<string>").alias("_found"))
    schema = out.schema
    for block in term_blocks(terms, ["term"], block_bytes):
        def matched(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _held(block, Terms)
            for batch in _parts(batches):
                found = [old + [matcher.terms[i] for i in matcher.contained(body.as_py())]
                         for body, old in zip(batch.column(n), batch.column(n + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n + 1], pa.array(found, pa.list_(pa.string()))],
                    batch.schema.names)

        out = out.mapInArrow(matched, schema)
    return out.select(*given, F.sort_array("_found").alias(output))


class Lemmas(dict):
    """Token to its shortest entry of one block among itself and its suffix rewrites."""

    def __init__(self, rows: list[tuple]) -> None:
        super().__init__()
        self.entries = {r[0] for r in rows}

    def __missing__(self, token: str) -> str | None:
        tried = [token, *(token[:len(token) - len(a)] + b
                          for a, b in NOUN_SUFFIXES if token.endswith(a))]
        known = [(len(t), i, t) for i, t in enumerate(tried) if t in self.entries]
        found = min(known)[2] if known else None
        if len(self) < 200_000:
            self[token] = found
        return found


def lemmatize(df: DataFrame, tokens: str, vocabulary: DataFrame, output: str | None = None,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Replace (or append as `output`) the array `tokens` by its lemmas: the shortest entry of
    `vocabulary` (term) among a token and its suffix rewrites, else the token."""
    given = df.columns
    n, at = len(given), given.index(tokens)
    blank = F.transform(F.col(tokens), lambda t: F.lit(None).cast("string"))
    out = df.select(*given, blank.alias("_best"))
    schema = out.schema

    def rank(token: str, lemma: str) -> tuple[int, int]:
        turns = [token, *(token[:len(token) - len(a)] + b if token.endswith(a) else None
                          for a, b in NOUN_SUFFIXES)]
        return len(lemma), turns.index(lemma)

    def better(token: str | None, old: str | None, new: str | None) -> str | None:
        if new is None or (old is not None and rank(token, old) <= rank(token, new)):
            return old
        return new

    for block in term_blocks(vocabulary, ["term"], block_bytes):
        def rewritten(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            lemmas = _held(block, Lemmas)
            for batch in _parts(batches):
                best = [None if words is None else
                        [old if w is None else better(w, old, lemmas[w])
                         for w, old in zip(words, olds)]
                        for words, olds in zip(batch.column(at).to_pylist(),
                                               batch.column(n).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array(best, pa.list_(pa.string()))],
                    batch.schema.names)

        out = out.mapInArrow(rewritten, schema)
    named = F.zip_with("_best", tokens, lambda lemma, token: F.coalesce(lemma, token))
    return out.withColumn(output or tokens, named).drop("_best")


def terms_table(df: DataFrame, terms: Iterable[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
