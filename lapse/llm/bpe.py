"""Exact byte-level BPE ids with a bounded cache.

Text is cut where the tokenizer's own pre-tokenisation surely cuts (at a lone
space between two other characters), so each unit can be looked up by itself;
units not seen lately are encoded from the same vocabulary given as ranks.
Texts with characters whose class may differ between Unicode versions go whole
to the ``tokenizers`` library, whose ids are the ones meant throughout."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import regex

#: Anything but characters whose class all Unicode versions in use agree on.
_UNSURE = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20ac]")
#: White space in some libraries only.
_DISPUTED = "\x1c\x1d\x1e\x1f\x85"
_OTHER_SPACE = "\t\r\x0b\x0c\xa0"


def _unsure(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNSURE.search(text) is not None
    return any(c in text for c in _DISPUTED)


def _lone_spaces(text: str) -> bool:
    """Every space stands between two characters that aren't white space."""
    return not (
        text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text
        or any(c in text for c in _OTHER_SPACE)
    )


#: Words in each of the cache's two generations.
CACHE_WORDS = 200_000


class _Bounded(dict):
    """A cache of two generations: when the young one is full it becomes the
    old one, and what is asked for again comes back from there."""

    def __init__(self, make, entries: int):
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BpeIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks_path: str, pattern: str, cache_words: int = CACHE_WORDS):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.after_space = _Bounded(lambda unit: self._unit(" " + unit), cache_words)

    def _unit(self, text: str) -> bytes:
        return self.ranks.encode_to_numpy(text, disallowed_special=()).tobytes()

    def library(self, text: str) -> bytes:
        if self.tokenizer is None:  # most tasks never need it
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _unsure(text):
            return self.library(text)
        if not _lone_spaces(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        return self._unit(first) + b"".join(map(self.after_space.__getitem__, rest))


@lru_cache(maxsize=2)
def bpe_ids(path: str, ranks_path: str, pattern: str, cache_words: int = CACHE_WORDS) -> BpeIds:
    """One per worker process: the cache outlives a task."""
    return BpeIds(path, ranks_path, pattern, cache_words)
