"""Vectorised tokenising and hashing of whole Arrow string columns.

A *slice* is a run of consecutive rows with a bounded number of bytes (a single
longer text makes a slice of its own). All work below is by NumPy over the
slice's bytes, so cost per text is small and memory follows the slice, not the
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

#: Odd multipliers of the rolling hashes, modulo 2**64.
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xC2B2AE3D27D4EB4F


def space_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def alnum_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after A-Z are lower-cased)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


SPACE_WORDS, ALNUM_WORDS, LOWER = space_table(), alnum_table(), lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = self._run(self.base, m), self._run(self.inverse, m)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, m: int) -> np.ndarray:
        out = np.ones(m, np.uint64)
        filled = 1
        while filled < m:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        return out


_WORD, _WINDOW = _Powers(WORD_BASE), _Powers(WINDOW_BASE)


@dataclass
class Words:
    """The words of one slice. ``doc`` is each word's row in the slice; ``first`` has, by row, the index of its first word (one entry more than rows)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length."""
        up, down = _WORD.get(len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        h = (run[self.end] - run[self.start]) * down[self.start]
        return mix(h ^ mix((self.end - self.start).astype(np.uint64)))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count and (lengths := np.diff(offsets))[nulls := np.asarray(col.is_null())].any():
        keep = np.repeat(~nulls, lengths)
        raw = raw[offsets[0] : offsets[-1]][keep]
        return raw, np.concatenate([[0], np.cumsum(np.where(nulls, 0, lengths))])
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that has more."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of rows whose bytes are ``data[offsets[i]:offsets[i + 1]]``; ``offsets`` start at 0."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words(data, offsets, start, end, doc, first)


def each_slice(col: pa.Array, table: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of each slice of a string column."""
    data, offsets = string_bytes(col)
    for lo, hi in slices(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, split_words(LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo], table)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive entries of ``h`` (entry i covers i to i + length - 1)."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    up, down = _WINDOW.get(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=run[1:])
    n = len(h) - length + 1
    return mix((run[length:] - run[:-length]) * down[:n])


def inside_one_row(words: Words, length: int) -> np.ndarray:
    """Whether the ``length`` words from each index on belong to one row."""
    n = len(words.doc) - length + 1
    return words.doc[length - 1 :] == words.doc[:n] if n > 0 else np.zeros(0, bool)
