"""Encoding by the tokenizers library, one text piece at a time, with the pieces seen before remembered.

Cutting before a blank that follows a non-blank character never changes the tokens: no pre-token of the supported
vocabularies holds a blank anywhere but at its start, and runs of white space stay whole. Texts that hold a special
string, and pieces with other characters than ``SIMPLE``, go to the library unchanged.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

# Inside a run of white space a blank is no safe place to cut
LOOSE_BLANK = re.compile(r" (?=\s|\Z)")
AFTER_WORD = re.compile(r"(?<=\S) ")
LONGEST_KEPT = 64
KEPT_PIECES, KEPT_WORDS = 700_000, 300_000
# Characters that any Unicode version reads alike and no normal form changes: ASCII and the letters of Latin-1
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf"[\t-\r -~{LETTERS}]*")
# The pre-token patterns of the two supported kinds of vocabulary, written for such characters
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(rf"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
WORD_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cut(text: str) -> list[str]:
    """Pieces that encode on their own. All but the first are to be read with one blank in front."""
    return AFTER_WORD.split(text) if LOOSE_BLANK.search(text) else text.split(" ")


class Remembered(dict):
    """piece -> value, computed on first use. Memory is bounded: long pieces are not kept, a full table starts anew."""

    def __init__(self, compute: Callable[[str], object], kept: int = KEPT_PIECES):
        super().__init__()
        self.compute, self.kept = compute, kept

    def __missing__(self, piece: str):
        value = self.compute(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.clear()
            self[piece] = value
        return value


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def simple_pattern(tokenizer) -> re.Pattern | None:
    """The pre-token pattern for ``SIMPLE`` texts, if the tokenizer is of a known kind."""
    kind = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space"):
        return BYTE_LEVEL
    steps = kind.get("pretokenizers") or [{}]
    return WORD_LEVEL if steps[0].get("pattern") == {"Regex": WORD_LEVEL_SPLIT} else None


class PieceEncoder:
    """Token ids of whole texts as little-endian 32-bit numbers, equal to the library's encoding of the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = simple_pattern(self.tokenizer)
        self.first = Remembered(lambda piece: self._encode(piece), KEPT_WORDS)
        self.rest = Remembered(self._after_blank)
        self.words = Remembered(self._merge, KEPT_WORDS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            mapped = word.replace(" ", self.letters[0x20])  # the only such byte that has another letter
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _after_blank(self, piece: str) -> bytes:
        if self.pattern is not None and piece.isascii() and piece.isalpha():  # one pre-token of either pattern
            return self.words[piece.lower() if self.pattern is WORD_LEVEL else " " + piece]
        return self._encode(" " + piece)

    def _encode(self, piece: str) -> bytes:
        if self.pattern is None or not SIMPLE.fullmatch(piece):
            return self.whole(piece)
        if self.pattern is WORD_LEVEL:
            piece = piece.lower()  # as that vocabulary's normaliser does
        return b"".join(map(self.words.__getitem__, self.pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.whole(text)
        pieces = cut(text)
        head = self.first[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file; its remembered pieces serve all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
