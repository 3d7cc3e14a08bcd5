"""Words of a whole Arrow batch as numpy arrays: bounds, row and a 64-bit hash for each word.

A word is a run of bytes outside ASCII white space. Texts are read straight from the
Arrow buffers, a few megabytes at a time, so that memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """row: position of the text in the slice; start, end: bytes in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefix: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        """For each text the index of its first word, and at the end the number of words."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))

    def hashes(self, start=None, end=None) -> np.ndarray:
        """A hash of the bytes from start to end; of each word if they are left out."""
        if self.prefix is None:
            n = 1 << max(12, int(len(self.data)).bit_length())
            self.prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _powers(_BASE, n)[: len(self.data)], dtype=np.uint64, out=self.prefix[1:])
        start, end = (self.start, self.end) if start is None else (start, end)
        n = 1 << max(12, int(len(self.data) + 1).bit_length())
        return mix((self.prefix[end] - self.prefix[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def cuts(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(column: pa.Array, lower: bool = True) -> Words:
    data, offsets = buffers(column)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data
    offsets = offsets - offsets[0]
    data = _LOWER[data] if lower else data
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | begins[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | begins[1:])) + 1
    return Words(data, offsets, np.searchsorted(offsets, start, side="right") - 1, start, end)


def slices(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of the whole column, slice by slice."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets = buffers(column)
    for at, to in cuts(offsets, most):
        yield at, to, words(column.slice(at, to - at), lower)


def windows(h: np.ndarray, row: np.ndarray, taken: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes over the words at the given distances from each word, and the index of that word.

    Only windows within one text count; ``taken`` ascends and its last entry is the span less one.
    """
    n = len(h) - taken[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.zeros(n, np.uint64)
    for k, t in enumerate(taken):
        s += h[t : t + n] * _FACTORS[k]
    ok = np.flatnonzero(row[:n] == row[taken[-1] :])
    return mix(s[ok]), ok
