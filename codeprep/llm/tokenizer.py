"""Byte-level BPE from a public rank file: pre-tokens by pattern, each encoded once."""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken

# Default place of the public vocabulary files; every function takes another one.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before the merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A task remembers pre-tokens until they take so many bytes, with what each costs besides its own.
REMEMBERED = 24_000_000
ENTRY = 190


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The vocabulary (some 50,000 entries), read on the driver and sent along with tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Texts to token ids; the sizes of pre-tokens are remembered within a task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pattern = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known = _Known(self.encoding)

    def ids(self, text: str) -> bytes:
        """All token ids of a text as bytes, two per token (little-endian)."""
        found = array("H", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def pre_tokens(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(end, number of tokens) of each pre-token from ``start`` on, one by one."""
        for match in self.pattern.finditer(text, start):
            yield match.end(), self.known[match.group()]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths in characters and tokens of all pre-tokens."""
        self.known.trim()
        found = self.pattern.findall(text)
        chars = np.fromiter(map(len, found), np.int64, len(found))
        return chars, np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))


class _Known(dict):
    """Pre-tokens to their number of tokens."""

    bytes_held = 0

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        self.bytes_held += ENTRY + 4 * len(piece)
        size = self[piece] = len(self.encoding.encode_ordinary(piece))
        return size

    def trim(self) -> None:
        if self.bytes_held > REMEMBERED:
            self.clear()
            self.bytes_held = 0
