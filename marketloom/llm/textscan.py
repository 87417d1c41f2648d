"""Scanning of whole text columns as bytes, with numpy, inside Arrow tasks.

Words are runs of bytes of a class, so a text is never turned into Python strings. Texts longer than ``CHUNK`` bytes are worked on in
pieces that end between words; the memory of a task follows the chunk, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}

WHITE = bytes([0x20, *range(0x09, 0x0E)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(inside) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of everything but ASCII white space; words of ASCII letters, digits and all other characters.
NOT_WHITE = byte_class(lambda b: b not in WHITE)
WORD_LIKE = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and their offsets; null counts as empty."""
    filled = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset: filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]: offsets[-1]] if len(flat) else flat, offsets - offsets[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, 2 * CHUNK)
    if "up" not in _POWERS or len(_POWERS["up"]) < size:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for name, factor in (("up", MULTIPLIER), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Substrings:
    """Hashes of any substrings of a byte array in constant time each, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        """Hash at every start of a substring of this length."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


@dataclass
class Words:
    """Words of one chunk: bytes of the chunk, then start, end (in the chunk) and row of each word, in order."""

    data: np.ndarray
    at: int
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def hashes(self) -> np.ndarray:
        return Substrings(self.data).hash(self.start, self.end)


def pieces(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about ``limit`` bytes that end between texts or between words."""
    lo, total = 0, int(offsets[-1])
    while lo < total:
        hi = min(lo + limit, total)
        if hi < total:
            border = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if border > lo:
                hi = border
            else:
                stop = int(offsets[np.searchsorted(offsets, lo, "right")])
                while hi < stop and inside[data[hi]] and inside[data[hi - 1]]:
                    hi += 1
        yield lo, hi
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, fold: np.ndarray = SAME) -> Iterator[Words]:
    """Words of all texts, chunk by chunk; a word never crosses texts."""
    firsts = offsets[:-1]
    for lo, hi in pieces(offsets, data, inside):
        part = fold[data[lo:hi]]
        is_word = inside[part]
        edge = np.zeros(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        a, b = np.searchsorted(offsets, (lo, hi))
        cuts = offsets[a:b] - lo
        edge[cuts[(cuts >= 0) & (cuts <= hi - lo)]] = True
        start_flag = is_word.copy()
        start_flag[1:] &= ~is_word[:-1] | edge[1:-1]
        end_flag = is_word.copy()
        end_flag[:-1] &= ~is_word[1:] | edge[1:-1]
        start, end = np.flatnonzero(start_flag), np.flatnonzero(end_flag) + 1
        yield Words(part, lo, start, end, np.searchsorted(firsts, start + lo, "right") - 1)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 * CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``limit`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(text_bytes(batch.column(column))[1])
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(lo, hi - lo)
