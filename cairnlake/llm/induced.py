"""Suffix sorting by induction with disk-backed queues.

The induction visits suffixes in order and puts each predecessor into the queue of its
first symbol; a queue is first in, first out, so it is a priority queue over (symbol,
order of the successor).  It is done a wave at a time: all suffixes that wait in a
symbol's queue, then those that they put into the same queue, until none is left.

Queues beyond ``memory`` suffixes go to disk, longest first, and come back in order.
The names of the induced LMS substrings are sorted by doubling, up to ``depth``
symbols, as no more is asked of a shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SYMBOLS = 257
MEMORY = 1 << 24


class Queues:
    """One first-in-first-out queue of positions for each symbol."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
        self.counts = np.zeros(SYMBOLS, np.int64)
        self.files: dict[int, list] = {}

    def put(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Append each position to its symbol's queue, in the order given."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
            self.parts[symbol].append(part)
            self.counts[symbol] += len(part)
        self.held += len(positions)
        while self.held > self.memory:
            self._spill(int(self.counts.argmax()))

    def append(self, symbol: int, positions: np.ndarray) -> None:
        self.parts[symbol].append(positions)
        self.counts[symbol] += len(positions)
        self.held += len(positions)
        while self.held > self.memory:
            self._spill(int(self.counts.argmax()))

    def _spill(self, symbol: int) -> None:
        if symbol not in self.files:
            self.files[symbol] = [tempfile.TemporaryFile(), 0]
        file = self.files[symbol]
        for part in self.parts[symbol]:
            file[0].write(part.astype(np.int64).tobytes())
            file[1] += len(part)
        self.held -= int(self.counts[symbol])
        self.counts[symbol], self.parts[symbol] = 0, []

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """All that waits in a queue, in order, a piece at a time; it is empty then."""
        file = self.files.pop(symbol, None)
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= int(self.counts[symbol])
        self.counts[symbol] = 0
        if file:
            file[0].seek(0)
            step = max(1, self.memory // 4)
            for at in range(0, file[1], step):
                yield np.frombuffer(file[0].read(8 * min(step, file[1] - at)), np.int64)
            file[0].close()
        if parts:
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type: smaller than the next one; the last is not."""
    n = len(text)
    ends = np.concatenate([np.flatnonzero(text[1:] != text[:-1]), [n - 1]])  # of the runs of equal symbols
    smaller = np.concatenate([text[ends[:-1] + 1] > text[ends[:-1]], [False]])
    return np.repeat(smaller, np.diff(np.concatenate([[-1], ends])))


def _induce(text: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (``seeds``)."""
    n, top = len(text), int(text.max())
    queues, sorted_l = Queues(memory), Queues(memory)
    queues.put(text[-1:], np.array([n - 1]))
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(top + 2))
    for c in range(top + 1):
        waves = list(queues.take(c))
        while waves:
            again = []
            for wave in waves:
                sorted_l.append(c, wave)
                before = wave[wave > 0] - 1
                symbols = text[before]
                again.append(before[symbols == c])
                later = symbols > c
                queues.put(symbols[later], before[later])
            again = np.concatenate(again)
            waves = [again] if len(again) else []
        before = seeds[bounds[c] : bounds[c + 1]]
        before = before[before > 0] - 1
        queues.put(text[before], before)
    out, end = np.empty(n, np.int64), n
    queues = Queues(memory)
    for c in range(top, -1, -1):
        waves = list(queues.take(c))
        while waves:
            again = []
            for wave in waves:
                out[end - len(wave) : end] = wave[::-1]
                end -= len(wave)
                before = wave[wave > 0] - 1
                symbols = text[before]
                again.append(before[symbols == c])
                later = symbols < c
                queues.put(symbols[later], before[later])
            again = np.concatenate(again)
            waves = [again] if len(again) else []
        for wave in reversed(list(sorted_l.take(c))):
            wave = wave[::-1]
            out[end - len(wave) : end] = wave[::-1]
            end -= len(wave)
            before = wave[wave > 0] - 1
            symbols = text[before]
            later = symbols < c
            queues.put(symbols[later], before[later])
    return out


def _substring_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from cairnlake.llm.textbytes import _CODES, _pow

    powers, inverse = _pow(len(text) + 1)
    codes = np.concatenate([_CODES, _CODES[:1] ^ np.uint64(0x5555555555555555)])
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[text] * powers[:-1], dtype=np.uint64)])
    return (prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _doubled(rank: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the LMS suffixes by their first ``depth`` symbols at least, from the ranks of their first LMS substrings.

    A rank is the number of smaller suffixes; only those that share theirs are sorted again.
    An LMS substring advances by two symbols at least.
    """
    n, step = len(rank), 1
    shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(shared) and 2 * step < depth and step < n:
        ahead = shared + step
        key = rank[shared] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, shared = key[order], shared[order]
        at = np.arange(len(key))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = key // (n + 1)
        start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[shared] = old + first - start
        alone = new & np.concatenate([new[1:], [True]])
        shared = shared[~alone]
        step *= 2
    return rank


def suffix_array(text: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """The suffixes of ``text`` (symbols 0 to 256), in order of their first ``depth`` symbols at least."""
    text = np.asarray(text, np.int16)
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, lms, memory)
    # LMS substrings in order, by one induction from seeds that are in order of their first symbol only
    rough = _induce(text, lms[np.argsort(text[lms], kind="stable")], memory)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    ends = np.zeros(n, np.int64)
    ends[lms] = np.concatenate([lms[1:] + 1, [n]])
    hashes = _substring_hashes(text, rough, ends[rough])
    hashes[rough == lms[-1]] ^= np.uint64(0x1234567)  # the last runs to the end and equals no other
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    place = np.zeros(n, np.int64)
    place[rough] = np.maximum.accumulate(np.where(new, np.arange(len(rough)), 0))  # where a name's suffixes begin
    rank = _doubled(place[lms], depth)
    return _induce(text, lms[np.argsort(rank)], memory)
