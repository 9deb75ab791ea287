"""Content-defined anchors: where equal long substrings can begin.

Every window of ``length`` bytes is assigned to the leftmost smallest of its ``GRAM``-byte
grams (by hash).  That choice depends on the window's bytes alone, so equal windows have
equal anchors at equal offsets: windows of different anchors need not be compared, and
those whose anchor gram is met once in the corpus are unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cairnlake.llm.textbytes import Spans, chunks, mix, utf8

GRAM = 32


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys: prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def content_ids(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(raw))
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, gram, context) of each run of windows with one anchor.

    ``start``: the first window's, in its text; ``context``: a hash of all bytes that the
    run's windows cover and of the anchor's place in them.
    """
    width = length - GRAM + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(raw) < length:
        return none
    spans = Spans(raw)
    at = np.arange(len(raw) - GRAM + 1)
    grams = mix(spans(at, at + GRAM), 3)
    place = _sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), width) & np.uint64(0xFFFFFFFF)
    place = place.astype(np.int64)
    starts, ends = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    valid = np.zeros(len(place) + 1, np.int32)
    np.add.at(valid, np.minimum(starts, len(place)), 1)
    np.add.at(valid, np.minimum(ends, len(place)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(place)) & (offsets[:-1] < offsets[1:])]
    new[inner] = valid[inner]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    count = np.add.reduceat(valid.astype(np.int64), first)
    text = np.searchsorted(offsets, first, "right") - 1
    anchor = place[first]
    context = mix(spans(first, first + count + length - 1) + (anchor - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407), 5)
    return text, first - offsets[text], count, grams[anchor], context


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(texts)
    for first, _, part, off in chunks(raw, offsets):
        yield first, part, off
