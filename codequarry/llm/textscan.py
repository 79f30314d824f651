"""Words and their hashes over a whole Arrow batch of texts at once, with numpy.

A batch of texts is one byte buffer with offsets. Words are runs of bytes other
than 0x20 and 0x09-0x0D; A-Z is lower-cased. The hash of a byte range is a
polynomial with an odd base modulo 2**64, taken from one running sum, so the
cost does not depend on how many ranges are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that are worked on at a time; a longer text stands alone.
SLICE_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, kept for the next batch."""
    if not _powers or len(_powers["up"]) <= n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(n + 1 + n // 4, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Scan:
    """Texts of one slice: ``buf`` is lower-cased bytes, ``off`` each text's first byte (and the end)."""

    buf: np.ndarray
    off: np.ndarray

    def words(self) -> Scan:
        """Find words: first byte, byte after the last, and the first word of each text."""
        n = len(self.buf)
        solid = ~_SPACE[self.buf]
        first = np.zeros(n + 1, dtype=bool)
        first[self.off] = True
        self.start = np.flatnonzero(solid & (first[:n] | np.concatenate(([True], ~solid[:-1]))))
        self.end = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
        self.word_off = np.searchsorted(self.start, self.off)
        return self

    def sums(self) -> np.ndarray:
        up, _ = powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        _, down = powers(len(self.buf))
        return mix64((sums[end] - sums[start]) * down[start])


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Scan]]:
    """Cut a batch into slices of about SLICE_BYTES; null is the empty text. Gives first row, row after the last, scan."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, Scan(_LOWER[raw[off[i] : off[j]]], off[i : j + 1] - off[i])
        i = j
