"""Ids of texts by a tokenizer of the tokenizers library, with what it says about a pre-token remembered.

A byte-level vocabulary encodes each pre-token by itself, and most of a corpus's pre-tokens have come before. So texts are cut here and
the library is asked for each new pre-token once. That is done where the cut is beyond doubt: no normaliser, the byte-level
pattern, no added token's string in the text, and letters of blocks whose classes are long settled. All other texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np

#: Blocks whose characters are all assigned, or never will be: Latin to its extension B, Cyrillic, and common punctuation.
_SETTLED = [(0x0000, 0x024F), (0x0400, 0x04FF), (0x2010, 0x2027), (0x2030, 0x203E), (0x20AC, 0x20AC)]
#: Pre-tokens that a worker remembers, in each of two generations; the older one goes when the newer is full. Longer ones aren't.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def _class(of: str) -> str:
    """A character class of the settled characters whose category starts so."""
    points = [p for low, high in _SETTLED for p in range(low, high + 1) if unicodedata.category(chr(p)).startswith(of)]
    cuts = [i for i in range(len(points)) if not i or points[i] != points[i - 1] + 1]
    return "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}" for a, b in zip(cuts, [*cuts[1:], len(points)]))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """(what cuts a text of settled characters into pre-tokens, a character that isn't settled)."""
    letters, numbers, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
    return cut, re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _SETTLED) + "]")


class Remembered(dict):
    """Ids of pre-tokens as bytes; one that is missing comes from the older generation or is asked for."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.older = ask, {}

    def __missing__(self, word: str) -> bytes:
        said = self.older.get(word)
        if said is None:
            said = self.ask(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = said
        return said


class Encoder:
    """A tokenizer file's ids of texts, as bytes of little-endian unsigned numbers (dtype says which)."""

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        if plain:
            self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.added = [t["content"] for t in said["added_tokens"]]
        self.dtype = np.dtype("<u2" if max(self.own.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        first = said.get("pre_tokenizer") or {}
        self.cuts = said.get("normalizer") is None and said["model"].get("type", "BPE") == "BPE" and not said["model"].get("dropout") and (first.get("type"), first.get("use_regex", True), first.get("add_prefix_space")) == ("ByteLevel", True, False)
        letters = {byte: letter for letter, byte in byte_letters().items()}
        self.letters, self.space = str.maketrans(letters), letters[32]
        self.known = Remembered(self._word)

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token."""
        if word.isascii() and word[1:].isalpha() and word[0] == " ":
            spelt = self.space + word[1:]
        else:
            spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.own.model.tokenize(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        cut, unsettled = _patterns()
        if not self.cuts or any(a in text for a in self.added) or not (text.isascii() or not unsettled.search(text)):
            return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        return b"".join(map(self.known.__getitem__, cut.findall(text)))


@cache
def encoder(path: str, plain: bool) -> Encoder:
    """A worker's encoder; with plain, special tokens' strings in texts are ordinary text."""
    return Encoder(path, plain)


def vocabulary_path(name: str) -> str:
    """A vocabulary of public_tokenizers, or the file at a path."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)
