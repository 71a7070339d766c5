"""Token counts by a compiled deterministic transducer.

A tokenizer file with byte-pair merges is compiled into two levels of transducer.

The outer one reads characters and cuts the normalised text into pieces, as the file's split
pattern does. ASCII white space ends every piece and never belongs to one, so all its states
fall together there: what stands between two white spaces, a word, has a count of its own.

The inner one reads a piece byte by byte. The last token of every prefix is the one vocabulary
entry that ends there and that the token before it lets stand, which merging the bytes of just
these two decides. A longer token can reach back only as far as the text read so far is the
beginning of some vocabulary entry. A state is therefore that stretch of text with the last
token and the number of tokens (relative to the newest) at each of its places; states are
made when first reached. Each transition is annotated with the change in the number of tokens,
so a piece's count is the sum along its path. Words that come again take a remembered path.
Tables are bounded and restarted when full; counts do not depend on what they hold.

Chunks of a text are summarised as maps: the fragment before their first white space, the
count between first and last, and the fragment after the last. Maps compose associatively, so
a prefix scan gives the count of every prefix of chunks and of the whole. Its upward half, a
tree of log depth, is all that the count of the whole needs, and holds every character once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk.
CHUNK = 1 << 16
#: Remembered words, and transitions, before a table starts anew.
MAX_WORDS, MAX_STEPS = 500_000, 400_000
#: Bytes of the longest word that is remembered.
MAX_WORD_BYTES = 256
#: Fixed value: the split pattern of the tokenizer file, white space spelled out.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
_SPACE = re.compile("[\t-\r ]")

#: (head, count, tail) of a chunk; without white space all of it is head and tail is None.
Map = tuple[str, int, str | None]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, all others for 256 and up in order.
    """
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Words(dict):
    """Word to count; a missing word is counted by the transducer."""

    def __init__(self, count) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        if len(word) > MAX_WORD_BYTES:
            return self.count(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self[word] = self.count(word)
        return found


class CountTransducer:
    """Number of tokens of a text under a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model["byte_fallback"]:
            raise ValueError("a byte-level BPE file with an end-of-word suffix is needed")
        self.specials = re.compile("|".join(re.escape(t["content"])
                                            for t in spec["added_tokens"]) or "(?!)")
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
                  for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        # Token to its symbols: one per byte, a different one for the last byte of a piece.
        self.spelled = {s: (s,) for c in letters for s in (c, c + self.suffix)}
        for a, b in merges:
            if a in self.spelled and b in self.spelled:
                self.spelled.setdefault(a + b, self.spelled[a] + self.spelled[b])
        # Entries that merging their own symbols does not give never appear.
        self.tokens = {t for t, s in self.spelled.items() if self.merge(s) == [t]}
        self.starts = {"".join(s[:i]) for t in self.tokens
                       for s in [self.spelled[t]] for i in range(1, len(s))}
        self.words = Words(self.word_count)
        self.pairs: dict[tuple[str, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        start = ("", (None,), (0,))
        self.states, self.ids, self.steps = [start], {start: 0}, {}

    def merge(self, symbols: tuple[str, ...]) -> list[str]:
        """Tokens of a symbol sequence: lowest-ranked pair first, leftmost first."""
        seq, none = list(symbols), len(self.ranks)
        while len(seq) > 1:
            rank, at = min((self.ranks.get(pair, none), i)
                           for i, pair in enumerate(zip(seq, seq[1:])))
            if rank == none:
                break
            seq[at:at + 2] = [seq[at] + seq[at + 1]]
        return seq

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves `left` and `right` apart when they stand together."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MAX_STEPS:
                self.pairs.clear()
            found = self.pairs[left, right] = (
                self.merge(self.spelled[left] + self.spelled[right]) == [left, right])
        return found

    def last_token(self, state: int, letter: str, suffix: str = "") -> tuple[str, int]:
        """The token that ends at `letter` and the change in the number of tokens."""
        text, lasts, counts = self.states[state]
        text += letter
        for i in range(len(lasts)):
            token = text[i:] + suffix
            if token in self.tokens and (lasts[i] is None or self.may_follow(lasts[i], token)):
                return token, counts[i] + 1
        raise ValueError(f"no token ends at {letter!r}")

    def step(self, state: int, letter: str) -> tuple[int, int]:
        """(next state, change in the number of tokens) of a transition, made on first use."""
        token, change = self.last_token(state, letter)
        text, lasts, counts = self.states[state]
        text += letter
        cut = next(i for i in range(len(text) + 1) if i == len(text) or text[i:] in self.starts)
        after = (text[cut:], (*lasts, token)[cut:],
                 tuple(n - change for n in (*counts, change)[cut:]))
        found = self.ids.get(after)
        if found is None:
            found = self.ids[after] = len(self.states)
            self.states.append(after)
        self.steps[state, letter] = found, change
        return found, change

    def piece_count(self, piece: str) -> int:
        """Tokens of one piece, given as its bytes' letters."""
        if len(self.steps) >= MAX_STEPS:
            self._restart()
        state = count = 0
        steps = self.steps
        for letter in piece[:-1]:
            state, change = steps.get((state, letter)) or self.step(state, letter)
            count += change
        end = piece[-1] + self.suffix
        found = steps.get((state, end))
        if found is None:
            found = steps[state, end] = 0, self.last_token(state, piece[-1], self.suffix)[1]
        return count + found[1]

    def word_count(self, word: bytes) -> int:
        """Tokens of what stands between two white spaces, as UTF-8."""
        text = word.decode("utf-8")
        count = 0
        for i, part in enumerate(self.specials.split(text)):
            count += i > 0  # the special string before this part is one token
            if not part.isascii():
                # Letter by letter: no rule for a sigma at the end of a word.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for piece in PIECES.findall(part.lower()):
                count += self.piece_count(
                    piece.encode("utf-8").decode("latin-1").translate(self.to_letters))
        return count

    def chunk_map(self, chunk: str) -> Map:
        first = _SPACE.search(chunk)
        if first is None:
            return chunk, 0, None
        last = max(chunk.rfind(c) for c in "\t\n\x0b\x0c\r ")
        inner = chunk[first.start():last].encode("utf-8").split()
        return chunk[:first.start()], sum(map(self.words.__getitem__, inner)), chunk[last + 1:]

    def _joint(self, text: str) -> int:
        return self.words[text.encode("utf-8")] if text else 0

    def compose(self, a: Map, b: Map) -> Map:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self._joint(a[2] + b[0]) + b[1], b[2]

    def reduce(self, maps: list[Map]) -> Map:
        """Composition of all maps, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        return maps[0]

    def scan(self, maps: list[Map]) -> list[Map]:
        """Composition of every prefix of `maps`: pairs upwards, then their prefixes downwards."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(maps[i], maps[i + 1])
                           for i in range(0, len(maps) - 1, 2)])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i])
                           for i in range(1, len(maps)))]

    def total(self, m: Map) -> int:
        return self._joint(m[0]) + m[1] + self._joint(m[2] or "")

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        return self.total(self.reduce(maps))


_compiled: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """The compiled file, once per worker."""
    if path not in _compiled:
        _compiled[path] = CountTransducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens. Every row is counted on its own, so
    ties and repeated rows change nothing. Columns of these three names are replaced.
    `tokenizer` is a file of the public tokenizers or a path that all executors have.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    names = [c for c in docs.columns if c != text and c not in new]
    held = docs.select(*(docs[c] for c in names),
                       F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
                       .alias("n_bytes"), docs[text].alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        machine = transducer(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = [machine.count(t.as_py(), chunk) for t in column]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                [*names, "n_bytes", "n_tokens", "over_limit"])

    schema = held.drop("_text").schema.add("n_tokens", "long").add("over_limit", "boolean")
    return held.mapInArrow(counted, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"))
