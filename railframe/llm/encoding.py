"""Encoding whole texts with a tokenizers file, word by word.

The normaliser of the word BPE file turns white space into single spaces, which its splitter drops, so a text's ids are
the ids of its words one after another, and words repeat. Each distinct word goes through the library once per Python
worker; a bounded cache keeps its ids as bytes.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

#: Words that a worker's cache holds before it starts anew.
CACHE_WORDS = 700_000

#: The splitter of the word BPE file, and the same for words of visible ASCII and À-ÿ in lower case, without Unicode's tables:
#: of these, a-z and all from à on but ÷ are letters (× and ÷ are none), 0-9 are numbers.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # parts are kept here, so each goes through the model once
            self.model._resize_cache(0)
        self.room = cache_words
        self.parts: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # Fixed shape that the word cache relies on; other files go through the library a text at a time.
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed"
        self.split = regex.compile(splits[0]["pattern"]["Regex"]) if self.by_word else None
        if self.by_word:
            pattern = splits[0]["pattern"]["Regex"]
            self.split_plain = (re.compile(PLAIN_SPLITTER) if pattern == SPLITTER else self.split).findall
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)").search
        # Latin-1 letters and visible ASCII: lower case and NFC are the same here as in the library.
        self.plain = re.compile(r"[\x21-\x7eÀ-ÿ]*").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        if self.plain(word) and not self.special(word):
            parts = self.split_plain(word.lower())
            found = self.part(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts))
        else:
            found = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = found
        return found

    def part(self, p: str) -> bytes:
        found = self.parts.get(p)
        if found is None:
            if len(self.parts) >= self.room:
                self.parts.clear()
            seen = p if p.isascii() else "".join(map(self.shown.__getitem__, p.encode()))
            found = self.parts[p] = self.packed([t.id for t in self.model.tokenize(seen)])
        return found

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
