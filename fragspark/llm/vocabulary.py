"""A byte-level BPE vocabulary read from a tokenizers JSON file, and cached encoding of whole texts.

Texts are taken apart at single spaces and line feeds that have no white space beside them: there the
vocabulary's pre-tokeniser always begins a new piece, so the ids of the parts, one after another, are
the ids of the text. Parts repeat a lot, so each is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: The pre-tokeniser's pattern, as the public tokenizer's description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may count as white space to any of the libraries; a break beside one of these is not used.
_BLANK = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
_BREAK = regex.compile(rf"(?<=[^ \n{_BLANK}])(?= [^ \n{_BLANK}])")
#: Parts longer than this are encoded each time; the cache holds two generations of this many parts.
LONGEST_KEPT, KEPT = 48, 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies, by its published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers JSON file."""

    def __init__(self, data: bytes) -> None:
        told = json.loads(data)
        letters = byte_letters()
        own = told["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        size = max([*own.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in own.items():
            self.token_bytes[i] = bytes(map(letters.__getitem__, text))
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.id_of = {self.token_bytes[i]: i for i in own.values()}
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.size = size
        #: left id * size + right id -> rank of the merge; rank -> id of the merged token
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[own[a] * size + own[b]] = rank
            self.made.append(own[a + b])


def _prose(text: str) -> bool:
    """Letters, full stops, commas, single spaces and line feeds, each mark right behind a letter."""
    for pair in ("  ", " \n", "\n ", "\n\n", " .", " ,", "\n.", "\n,", "..", ".,", ",.", ",,"):
        if pair in text:
            return False
    return text[:1] not in (".", ",") and text.replace(" ", "").replace(",", "").replace(".", "").replace("\n", "").isalpha()


def _lone_breaks(text: str) -> bool:
    """Every space and line feed stands alone, and no other white space occurs."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text:
        return False
    return not any(c in text for c in (_BLANK[:8] if text.isascii() else _BLANK))


def parts_of(text: str) -> list[str]:
    """The text cut where a new piece always begins; joined again, the parts are the text."""
    if _prose(text):
        text = text.replace(".", "\0.").replace(",", "\0,")
    elif not _lone_breaks(text):
        return _BREAK.split(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class PartCache(dict):
    """part -> ids as little-endian integers of the vocabulary's width, in two bounded generations."""

    def __init__(self, encode_part=None, kept: int = KEPT) -> None:
        super().__init__()
        self.encode_part, self.kept = encode_part, kept
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = self.encode_part(part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, parts_of(text)))
