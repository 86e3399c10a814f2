"""Word shingles of normalized texts, hashed without a Python string per word.

A normalized text is lower case, with single spaces between words and none at the ends, so the k consecutive words
from word i on are one stretch of bytes. Its hash is a polynomial over those bytes modulo 2^64, read off prefix sums
and then mixed; a batch of texts costs a fixed number of numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def normalized(text: Column) -> Column:
    """Lower case; runs of characters that are neither letters nor numbers become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, SLICE_BYTES)
            one = np.ones(self.n, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text) of non-empty normalized texts; raw[offsets[i]:offsets[i + 1]] is text i.

    A text of fewer than k words has one shingle: the whole text.
    """
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    starts = np.sort(np.concatenate([offsets[:-1], spaces + 1]))
    ends = np.sort(np.concatenate([spaces, offsets[1:]]))
    first_word = np.searchsorted(starts, offsets[:-1])
    words = np.diff(np.r_[first_word, len(starts)])
    counts = np.maximum(words - (k - 1), 1)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    total = int(counts.sum())
    word = np.arange(total) - np.repeat(first - first_word, counts)
    last = np.minimum(word + (k - 1), np.repeat(first_word + words - 1, counts))
    s, e = starts[word], ends[last]
    return mix((sums[e] - sums[s]) * down[s]), first


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column without nulls, in slices of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, end, raw, offsets[begin : end + 1]
        begin = end
