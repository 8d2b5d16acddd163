"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

A byte-level tokenizer splits a text into words, numbers, signs and blanks before it merges. Where
such a piece is sure to end, the text may be cut and the pieces encoded alone. Most pieces of a
corpus repeat, so a worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .store import kept_by_worker

#: Pieces kept by a worker (some 200 bytes each); when full it starts anew.
KEPT = 500_000
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
SIMPLE = rf" ?[{LETTER}]+| ?[0-9]+| ?[!-&(-/:-@\[-`{{-~]+|\n"
#: A word, number or run of signs before something that ends it; one newline between others; or
#: else all up to the next blank that follows something else.
PIECE = re.compile(
    rf" ?[{LETTER}]+(?=[\t-\r -@\[-`{{-~]|\Z)"
    rf"| ?[!-&(-/:-@\[-`{{-~]+(?=[\t-\r 0-9A-Za-z]|\Z)"
    rf"| ?[0-9]+(?=[\t-\r -/:-~]|\Z)"
    rf"|\n(?=[!-~{LETTER}])"
    rf"|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"
)
ALONE = re.compile(SIMPLE)
#: A blank that only Unicode or only some libraries know, before an ASCII blank: no place to cut.
UNSAFE = re.compile("[\x1c-\x1f\u0085   -     　][ \t-\r]")


SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte, by rule: printable Latin-1 bytes stand for
    themselves, the others for the letters from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """Ids (little-endian unsigned 32-bit) by piece."""

    def __init__(self, tokenizer):
        super().__init__()
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = tokenizer.model.tokenize
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if ALONE.fullmatch(piece):
            tokens = self.merge(piece.encode().decode("latin-1").translate(self.letters))
        else:
            tokens = [token for word, _ in self.split(piece) for token in self.merge(word)]
        ids = array("I", [token.id for token in tokens]).tobytes()
        if len(self) >= KEPT:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """encode(text) gives the bytes of tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        known = isinstance(self.tokenizer.model, models.BPE) and isinstance(
            self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel
        )
        self.cuts = known and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.tokenizer) if self.cuts else {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        odd = any(c in text for c in SEPARATORS) if text.isascii() else UNSAFE.search(text)
        if not self.cuts or odd or any(token in text for token in self.special):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    kept = kept_by_worker("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
