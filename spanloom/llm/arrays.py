"""Words of Arrow batches as flat numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

#: Blank and the controls from tab to carriage return separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers for the bytes of a word, by position; repeated beyond.
SPREAD = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def tidy() -> None:
    """Gives memory that isn't used any more back to the system; workers live on between tasks, the driver between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of rows: where each starts and ends, and to which row it belongs."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw = raw = LOWER[raw] if lower else raw
        self.n_rows = len(offsets) - 1
        inside = ~SEPARATOR[raw]
        head = np.zeros(len(raw) + 1, bool)  # a row's first byte starts a word whatever stands before
        head[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | head[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside
        self.end = np.flatnonzero(inside & (~after | head[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=self.n_rows)

    def hashes(self) -> np.ndarray:
        """64 bits of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        inside = self.raw[~SEPARATOR[self.raw]]  # the bytes of all words, one after the other
        parts = (inside.astype(np.uint64) + np.uint64(1)) * SPREAD[place & 255]
        if (size > 256).any():  # beyond 256 bytes places repeat, so each block is weighed by its number
            parts *= (place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        return mixed(np.add.reduceat(parts, first) + size.astype(np.uint64))

    def edge(self, n: int, tail: bool = False) -> np.ndarray:
        """The first (or last) n bytes of every word in lower case, as numbers; shorter words fill up with 0."""
        out = np.zeros(len(self.start), np.uint64)
        for k in range(n):
            at = self.end - 1 - k if tail else self.start + k
            ok = at >= self.start if tail else at < self.end
            out = (out << np.uint64(8)) | np.where(ok, LOWER[self.raw[np.where(ok, at, 0)]], 0).astype(np.uint64)
        return out
