"""Token ids by the tokenizers library, with a memory of the pieces that it has encoded.

Words repeat, and the public vocabularies never merge across white space, nor between a run of letters and what
is no letter. So a text is cut there, each distinct piece is encoded once by the library, and later meetings are looked up.
Apostrophes may begin a contraction: what holds one is cut at white space only. A text with characters beyond
Latin-1 and common punctuation is cut at white space only; one with unusual white space, or with what begins a special token's marker, is
encoded as a whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœŸ"
#: White space leads the token that follows: runs of it are cut as a byte-level vocabulary does, before one blank.
_BLANK = r"[ \t\n\r]+(?![^ \t\n\r])"
LEADING = re.compile(rf" ?[{_LETTERS}]++(?!')| ?[^ \t\n\r'{_LETTERS}]++(?!')|{_BLANK}| ?[^ \t\n\r]+|[ \t\n\r]+")
LEADING_WIDE = re.compile(rf"{_BLANK}| ?[^ \t\n\r]+|[ \t\n\r]+")
#: White space is dropped.
DROPPED = re.compile(rf"[{_LETTERS}]++(?!')|[^ \t\n\r'{_LETTERS}]++(?!')|[^ \t\n\r]+")
WIDE = re.compile("[^\\x00-\\xffŒœŸ€–—‘-‟…]")
ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0  -‍    　﻿]|<\\|")


_WORD = re.compile(rf" ?[{_LETTERS}]+").fullmatch
_PACKERS = [struct.Struct(f"<{k}I").pack for k in range(64)]


def _byte_alphabet() -> dict[int, str]:
    """Code point (up to U+017F) -> its UTF-8 bytes as byte-level vocabularies spell them: visible bytes as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0x180)}


class _Memory(dict):
    """piece -> ids; a piece met for the first time is encoded then."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Encoder:
    """path: a tokenizer file. dropped: the vocabulary lower-cases and drops white space (else white space leads the next token)."""

    def __init__(self, path: str, dropped: bool, memory: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.dropped, self.memory = Tokenizer.from_file(path), dropped, memory
        self.known = _Memory(self._one)
        # a run of letters is one word to the model: it can be put there directly, in the byte alphabet, if that gives the same ids
        self.model, self.alphabet, self.by_model = self.tokenizer.model, _byte_alphabet(), True
        probes = ["a", "hello", "été", "straße", "ñandú", "œuvre", *([] if dropped else [" world", " Über"])]
        self.by_model = [self._one(p) for p in probes] == self._whole(probes)

    def _one(self, piece: str) -> bytes:
        if self.by_model and (piece.isascii() and (piece.isalpha() or (piece[0] == " " and piece[1:].isalpha())) or _WORD(piece)):
            ids = [t.id for t in self.model.tokenize((piece.lower() if self.dropped else piece).translate(self.alphabet))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return _PACKERS[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        if not text.isascii():
            if ODD.search(text):
                return None
            if WIDE.search(text):
                return text.split() if self.dropped else LEADING_WIDE.findall(text)
        elif "<|" in text or ODD.search(text):
            return None
        return DROPPED.findall(text.lower()) if self.dropped else LEADING.findall(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.memory:
            self.known.clear()
        look = self.known.__getitem__
        return [self._whole([t])[0] if (pieces := self._cut(t)) is None else b"".join(map(look, pieces)) for t in texts]


@lru_cache(4)
def encoder(path: str, dropped: bool) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, dropped)


def public_path(name: str) -> str:
    """A public vocabulary's place on this machine, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
