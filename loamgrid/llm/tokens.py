"""Tokenising with the public word-level BPE vocabulary, inside Spark tasks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable

#: Stretches and parts of them whose ids one worker keeps, all in all; beyond it the tables start anew.
CACHE_WORDS = 1_000_000

# The vocabulary's own splitting pattern, spelled out for the
# characters up to U+00FF, all of which are unchanged by its NFC step.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WHITE = "\t-\r \x85\xa0"
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Known(dict):
    """Ids by stretch; what is missing is made on first use, and kept unless it is long."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, stretch: str) -> bytes:
        ids = self.make(stretch)
        if len(stretch) < 64:
            self[stretch] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's splitter never joins characters across white space, so the
    ids of a text are those of its space-separated stretches one after another.
    A stretch is looked up, else split as the vocabulary splits it, and each
    new part goes through the library's model once per worker. A stretch with
    characters beyond U+00FF goes through the library's whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = _byte_characters()
        self.stretches, self.parts = _Known(self._stretch), _Known(self._part)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.bytes)
        tokens = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def _stretch(self, stretch: str) -> bytes:
        if max(stretch, default="") > "\xff" or ("<|" in stretch and any(s in stretch for s in self.special)):
            tokens = self.tokenizer.encode(stretch, add_special_tokens=False).ids
            return struct.pack(f"<{len(tokens)}I", *tokens)
        return b"".join(map(self.parts.__getitem__, _SPLIT.findall(stretch.lower())))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self.stretches) + len(self.parts) > CACHE_WORDS:
            self.stretches.clear()
            self.parts.clear()
        take = self.stretches.__getitem__
        return [b"".join(map(take, (t or "").replace("\n", " ").split(" "))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
