"""Words of whole texts as 64-bit keys, taken from Arrow batches with array arithmetic.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Texts are read in chunks of about ``CHUNK`` bytes (a longer text
is a chunk of its own), so the memory of a task follows the chunk and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class _Tables:
    """Powers of the base and of its inverse, grown on demand."""

    power = _powers(_BASE, CHUNK)
    inverse = _powers(_BASE_INVERSE, CHUNK)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(cls.power):
            cls.power, cls.inverse = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return cls.power, cls.inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Some whole texts of one Arrow array: rows first .. first + rows."""

    first: int
    rows: int
    data: np.ndarray       # bytes of the texts, one behind the other (lowered where asked)
    text_at: np.ndarray    # rows + 1 byte positions
    start: np.ndarray      # byte positions of words
    end: np.ndarray
    word_at: np.ndarray    # rows + 1 positions in start/end
    key: np.ndarray | None  # a 64-bit key for each word

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that begin a window of n words of one text, and the windows' keys."""
        at = self.window_starts(n)
        return at, (window_keys(self.key, n)[at] if len(at) else np.zeros(0, np.uint64))

    def window_starts(self, n: int) -> np.ndarray:
        last = np.repeat(self.word_at[1:], self.counts())
        return np.flatnonzero(np.arange(len(self.start)) + n <= last)


def window_keys(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of all windows of n consecutive entries; windows that run over a text's end are for the caller to skip."""
    size = len(key) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = key[:size].copy()
        for k in range(1, n):
            out *= _STEP
            out += key[k:k + size]
    return mixed(out ^ np.uint64(n))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and len + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(texts: pa.Array, lower: bool = False, keys: bool = True, size: int = CHUNK) -> Iterator[Chunk]:
    if not len(texts):
        return
    data, at = buffers(texts)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        part = data[at[first]:at[stop]]
        yield _chunk(first, _LOWER[part] if lower else part, at[first:stop + 1] - at[first], keys)
        first = stop


def _chunk(first: int, data: np.ndarray, text_at: np.ndarray, keys: bool) -> Chunk:
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = text_at[:-1][np.diff(text_at) > 0]  # a text's first and last byte bound words as well
    begins[edges] = inside[edges]
    lasts = text_at[1:][np.diff(text_at) > 0] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word_at = np.searchsorted(start, text_at)
    return Chunk(first, len(text_at) - 1, data, text_at, start, end, word_at, span_keys(data, start, end) if keys else None)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Differences of running polynomial sums, block by block so that a very long text needs no long tables."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        low = start[done]
        stop = max(done + 1, int(np.searchsorted(end, low + CHUNK, "right")))
        high = end[stop - 1]
        power, inverse = _Tables.upto(int(high - low))
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUE[data[low:high]] * power[:high - low], out=sums[1:])
            out[done:stop] = (sums[end[done:stop] - low] - sums[start[done:stop] - low]) * inverse[start[done:stop] - low]
        done = stop
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Consecutive slices of values as an Arrow list column."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


class Lookup:
    """A fixed map from 64-bit keys to small rows by open addressing, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.table[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.table[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[np.maximum(out[open_], 0)] != keys[open_])]
        return out
