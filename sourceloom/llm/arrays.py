"""Texts of an Arrow batch as flat numpy arrays: bytes, words, window hashes.

A batch is walked in slices of about half a megabyte of text (a longer text is a slice of its own), so the
working memory of a task is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

# White space that separates words, and the word characters of the benchmark check.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_PUNCTUATION = np.ones(256, bool)          # everything but digits, letters a-z and bytes above ASCII
IS_PUNCTUATION[0x30:0x3A] = False
IS_PUNCTUATION[0x61:0x7B] = False
IS_PUNCTUATION[0x80:] = False

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        have = _powers[key]
        while len(have) < n:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        _powers[key] = have
    return _powers["up"], _powers["down"]


class Prefix:
    """Polynomial prefix sums over a sequence of 64-bit values; any span hashes in constant time."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        up, self._down = _power(self.n + 1)
        self._sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * up[:self.n], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` values (none if there are fewer)."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self._sums[k:] - self._sums[:-k]) * self._down[:self.n - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column. A null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive groups of rows; offsets start at 0."""
    if not batch.num_rows:
        return
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield slice(first, last), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


class Words:
    """Words of a slice: byte spans, the first word of each row, and a 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE,
                 lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        gap = np.ones(len(data) + 1, bool)
        gap[:-1] = separator[data]
        before = np.ones(len(data), bool)
        before[1:] = gap[:-2] if len(data) > 1 else True
        first = offsets[:-1][offsets[:-1] < len(data)]
        before[first] = True
        after = gap[1:].copy()
        ends = offsets[1:][(offsets[1:] > 0)] - 1
        after[ends] = True
        inside = ~gap[:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.rows = np.searchsorted(self.starts, offsets)          # first word of each row, and the total
        self._hashes = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = np.empty(len(self), np.uint64)
            first = 0
            while first < len(self):               # a piece of about half a megabyte, so that long texts need no wide arrays
                at = self.starts[first]
                last = max(int(np.searchsorted(self.ends, at + SLICE_BYTES, side="right")), first + 1)
                piece = Prefix(BYTE_VALUES[self.data[at:self.ends[last - 1]]])
                self._hashes[first:last] = piece.spans(self.starts[first:last] - at, self.ends[first:last] - at)
                first = last
        return self._hashes

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
