"""Token ids of texts by a public tokenizer, as little-endian unsigned 32-bit bytes.

The byte-level BPE splits a text before every white-space character that follows a
character of another kind, and never merges across such a split. So a text without two
adjacent white-space characters can be cut at its spaces and newlines and the pieces looked
up in a cache; only pieces not seen before need the tokenizer. Other texts, and those that
hold a special token's string, are given to the tokenizer whole. Either way the ids are
those of encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import os
import re
from array import array

from . import workers

#: Pieces that a Python worker remembers, about 200 bytes each; the cache starts anew beyond it.
CACHE_ENTRIES = 500_000
_SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TWO_SPACES = re.compile(r"\s\s")
_encoders: dict[str, "Encoder"] = {}
workers.on_change(_encoders.clear)


def _shown() -> dict[int, int]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if it is printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


_SHOWN = _shown()
_SPACE = chr(_SHOWN[32])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> "Encoder":
    """The worker's encoder for a vocabulary file (workers are reused between tasks)."""
    workers.turn_to("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path, cache_entries)
        workers.trim()  # what reading the vocabulary has left
    return _encoders[path]


class _Pieces(dict):
    """Piece -> ids; a piece is what follows a space, or starts with a newline."""

    def __init__(self, encode, encode_word, limit: int):
        self.encode, self.encode_word, self.limit = encode, encode_word, limit
        self.newline = encode("\n")
        self.marks = {mark: encode(mark) for mark in ".,;:!?|"}

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            ids = self.encode_word(" " + piece)
        elif piece[-1:] in self.marks and piece[:-1].isalpha():  # letters and a mark are never merged
            ids = self[piece[:-1]] + self.marks[piece[-1]]
        elif (head := piece.rstrip(_SYMBOLS)) != piece and head.isalpha():  # nor letters and a run of symbols
            tail = piece[len(head) :]
            if tail not in self.marks:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[tail] = self.encode(tail)
            ids = self[head] + self.marks[tail]
        elif piece.startswith("\n"):
            rest = piece[1:]
            ids = self.newline + ((self.encode_word(rest) if rest.isalpha() else self.encode(rest)) if rest else b"")
        else:
            ids = self.encode(" " + piece)
        if len(self) >= self.limit:
            self.clear()
            workers.trim()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The cut into pieces is right for byte-level models without a normalizer; others get whole texts.
        self.cuts = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and type(self.tokenizer.model).__name__ == "BPE" and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.model = self.tokenizer.model
        self.pieces = _Pieces(self.plain, self.word, cache_entries) if self.cuts else None

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word, with or without a space before it: one step of the model."""
        shown = word.replace(" ", _SPACE) if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def plain_without_specials(self, text: str) -> bytes:
        """Ids of a text whose special tokens' strings count as ordinary text."""
        self.tokenizer.encode_special_tokens = True
        try:
            return self.plain(text)
        finally:
            self.tokenizer.encode_special_tokens = False

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (None: no ids)."""
        if not text:
            return b""
        if not self.cuts or _TWO_SPACES.search(text) or any(s in text for s in self.special):
            return self.plain(text)
        cut = iter(text.replace("\n", " \n").split(" "))
        start = next(cut)
        return (self.plain(start) if start else b"") + b"".join(map(self.pieces.__getitem__, cut))
