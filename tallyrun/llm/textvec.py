"""Whole-batch tokenising and hashing with numpy: the inner loops of the Arrow tasks.

A batch of texts is one byte array plus offsets, as Arrow holds it, so no Python object is made per word.
Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes, which is the same as over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


POWERS = 4096
POW = constants(POWERS, 11)
BYTE = constants(256, 7)
BYTE_WORDS = np.where(SPACE, np.uint64(0), BYTE)
_upper = np.arange(256)
_upper[65:91] += 32
BYTE_LOWER = BYTE_WORDS[_upper]
GRAM = constants(64, 23)


def slices(column: pa.Array, most: int = 128 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes: (first row, end row, bytes, offsets from 0).

    Small runs keep the 64-bit work arrays in the processor's cache.  Nulls are empty texts.  A single text longer than ``most`` makes a run of its own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_starts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word, and for each text the index of its first word (one more entry at the end)."""
    gap = space[data]
    first = ~gap
    first[1:] &= gap[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = ~gap[at]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray = BYTE_WORDS) -> np.ndarray:
    """A 64-bit hash of each word; bytes whose value is 0 (white space) do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(starts, append=len(data))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        x = values[data[starts[0] :]]
        x = x * POW[within & (POWERS - 1)]
        far = within >= POWERS
        if far.any():
            x[far] *= mix(within[far].astype(np.uint64) >> np.uint64(12)) | np.uint64(1)
        return mix(np.add.reduceat(x, starts - starts[0]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on (len - n + 1 of them, text borders not considered)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m] * GRAM[0]
        for k in range(1, n):
            out += hashes[k : k + m] * GRAM[k]
        return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, values: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, sorted within it, and each text's bounds.

    Texts of fewer than n words (but one at least) have the whole sequence as their one shingle.
    """
    starts, first = word_starts(data, offsets)
    hashes = word_hashes(data, starts, values)
    counts = np.diff(first)
    ngrams = grams(hashes, n)
    many = np.maximum(counts - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    inside = np.repeat(first[:-1], many) + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    values_, owners = ngrams[inside] if len(owner) else np.zeros(0, np.uint64), owner
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([mix(np.add.reduce(hashes[first[i] : first[i + 1]] * GRAM[32 : 32 + counts[i]], keepdims=True))[0] for i in short], np.uint64)
        values_, owners = np.concatenate([values_, whole]), np.concatenate([owners, short])
    bounds = np.searchsorted(owners, np.arange(len(counts) + 1)) if not len(short) else None
    if bounds is None:
        order = np.argsort(owners, kind="stable")
        values_, owners = values_[order], owners[order]
        bounds = np.searchsorted(owners, np.arange(len(counts) + 1))
    parts = [np.unique(values_[i:k]) for i, k in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(parts) if parts else values_, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
