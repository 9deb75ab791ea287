"""Vectorised work on batches of UTF-8 text: word spans and polynomial hashes with numpy.

A batch is a byte array and offsets, taken from Arrow without copying.  Hashes are
polynomials over random 64-bit byte codes modulo 2**64, so that every span of the
buffer has its hash from two prefix sums; ``mix`` finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17  # so that arrays of eight bytes for each byte stay in a cache
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

#: Bytes that end a word for the shingle operators: space and TAB to CR.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about ``most`` bytes; a longer text is a piece of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        one = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        one[0][0] = one[1][0] = 1
        got = np.multiply.accumulate(one[0]), np.multiply.accumulate(one[1])
        if n > 4 * CHUNK_BYTES:
            return got
        _powers = got
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; it keeps different values different."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of one byte array."""

    def __init__(self, raw: np.ndarray):
        powers, self.inverse = _pow(len(raw) + 1)
        self.prefix = np.empty(len(raw) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_CODES[raw] * powers[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans [start, end), their lengths included; unmixed."""
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def word_spans(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first of its words (n + 1 values).

    ``apart``: for each byte, whether it separates words.  A word never crosses texts.
    """
    inside = ~apart
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text): all runs of ``size`` words; a shorter text is one shingle, none without words.

    ``words`` are mixed word hashes.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(n_words.dtype))
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    end = np.repeat(first[1:], n)
    out = np.full(len(index), 0x2545F4914F6CDD1D, np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        here = padded[index + k]
        out = (out ^ np.where(index + k < end, here, np.uint64(k + 1))) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out), at
