"""Ids of a byte-level BPE file, equal to the tokenizers library's.

The library needs about a microsecond for each byte of text, most of it for tokens with
offsets that nobody reads here. So the file's own entries are also given to a second library's
merge loop (`tiktoken`), which returns an array of ids only. The two agree if the file splits
text by the usual pattern, ranks merges in the order of their ids and can reach each of its
entries; the file is checked for that once per worker. Files that fail the check, texts with a
special string and texts with a very long run of white space, which the second library's
pattern engine cannot hold, are left to the first.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Longest run of white space that goes to the fast library.
MAX_SPACES = 8192
_RUN = re.compile(r"\s{%d}" % MAX_SPACES)


def byte_values() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, all others for 256 and up in order.
    """
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in kept else next(spare)): b for b in range(256)}


def find_file(tokenizer: str) -> str:
    """A path as it is; a bare name is one of the public tokenizers."""
    return tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)


class ByteBPE:
    """Encoder of one tokenizer file; `size[i]` is the number of bytes of id i."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        self.specials = re.compile("|".join(
            re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        values = byte_values()
        entries = {token: bytes(values[c] for c in token)
                   for token in spec["model"].get("vocab", ()) if all(c in values for c in token)}
        vocab = spec["model"].get("vocab", {})
        self.entry = {vocab[token]: raw for token, raw in entries.items()}
        self.size = np.zeros(max(self.entry, default=0) + 1, np.int64)
        for i, raw in self.entry.items():
            self.size[i] = len(raw)
        self.core = None
        if self._same_rules(spec):
            added = {t["content"] for t in spec["added_tokens"]}
            self.core = tiktoken.Encoding(
                "file", pat_str=public_tokenizers.PATTERN, special_tokens={},
                mergeable_ranks={raw: vocab[t] for t, raw in entries.items() if t not in added})

    def _same_rules(self, spec: dict) -> bool:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel"
                or cut.get("add_prefix_space") or not cut.get("use_regex", True)
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                              "end_of_word_suffix", "fuse_unk", "byte_fallback",
                                              "ignore_merges"))):
            return False
        vocab = model["vocab"]
        ranked = [vocab["".join(m.split(" ") if isinstance(m, str) else m)]
                  for m in model["merges"]]
        added = {t["content"] for t in spec["added_tokens"]}
        return ranked == sorted(ranked) and all(
            [t.id for t in self.library.model.tokenize(token)] == [i]
            for token, i in vocab.items() if token not in added)

    def _ids(self, text: str, library: Tokenizer) -> np.ndarray:
        if self.core is None or (len(text) >= MAX_SPACES and _RUN.search(text)):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.core.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as the library gives them by default: special strings are special tokens."""
        if not text:
            return np.empty(0, np.uint32)
        if self.specials.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._ids(text, self.library)

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids with special strings as ordinary text."""
        return self._ids(text, self.plain)


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(tokenizer: str) -> ByteBPE:
    """The file's encoder, once per worker."""
    path = find_file(tokenizer)
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
