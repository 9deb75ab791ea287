"""Sum-of-squares online packing of tokenised documents (operator 9).

Each task packs the documents of its input partition as they come, so nothing is
shuffled and a lost task is simply run again.  A document's full windows are cut
off first; its rest goes to the fill level for which the sum of the squared counts
of partially filled windows grows least, found in one array of counts by level.
When the input ends, the windows still open are topped up with pieces cut from the
emptiest ones, and what is left is cut into powers of two, which need no padding.

State of a task: one count and one stack of windows a level, and the rows of the
open windows, which the sum of squares keeps few.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairnlake.llm.runtime import trimmed

WINDOW = 4096
END_ID = 2
CACHED_WORDS = 600_000
TEXTS = 512  # encoded together
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The installed vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


_CASED = re.compile("[\u03a3\u0130]")  # letters whose lower case depends on what stands around them


_PROBES = ["then", "thntatwh", "qzxj", "a", "naïve", "über", "été", "слово", "日本", "ñandú"]
# the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds:
    """Token ids of texts, by way of a bounded cache of the ids of their space-separated words.

    Exact for tokenizers whose pre-tokenizer drops white space and never joins what
    stands on both sides of it, as the word-level BPE here; ``tests/llm`` holds it
    against the tokenizer's own output.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # a lower-case word needs no normaliser and no splitting, if the model alone gives the same
        self.direct = all(self._of_model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES)

    def _of_model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))]

    def _learn(self, words: list[str]) -> None:
        """Put the words into ``known``; spellings that come to the same tokens share an encoding."""
        known, tokenize, later = self.known, self.tokenizer.model.tokenize, []
        for word in words:
            core = word.rstrip(string.punctuation)  # marks behind letters are tokens of their own in any case
            if self.direct and core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and not _CASED.search(core)):
                marks, core = word[len(core) :], core.lower()  # the tokenizer does so too
                ids = known.get(core)
                if ids is None:
                    ids = known[core] = array("I", [t.id for t in tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
                if marks and marks not in known:
                    known[marks] = self._encoded([marks])[0]
                known[word] = ids + known[marks] if marks else ids
            else:
                later.append(word)
        for at in range(0, len(later), 10_000):
            part = later[at : at + 10_000]
            known.update(zip(part, self._encoded(part), strict=True))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(text: str) -> str:
        """The text in lower case, where the tokenizer is sure to come to the same from either."""
        low = text.lower()
        same = text.isascii() or not _CASED.search(text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return (low if same and "<|" not in text else text).replace("\n", " ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Words are split, told apart and put together again by Arrow; Python sees each word of the texts once.
        """
        split, known = pc.split_pattern(pa.array(map(self._plain, texts), pa.large_string()), " "), self.known
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much cheaper than to_pylist
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = words
        self._learn(new)
        found = pa.array(map(known.__getitem__, words), pa.large_binary()).take(coded.indices)
        _, ends, joined = found.buffers()
        at = np.frombuffer(ends, np.int64)[found.offset :][split.offsets.to_numpy()]
        return [joined[a:b].to_pybytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Packer:
    """Packs pieces of documents into windows; ``add`` and ``close`` give finished rows."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self.counts = np.zeros(window + 1, np.int64)
        self.stacks: list[list[list]] = [[] for _ in range(window)]

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, size: int) -> int:
        """The level whose choice makes the sum of squares grow least; the fullest of equals, 0 for a new window."""
        w, n = self.window, self.counts
        grows = 1 - 2 * n[1 : w - size + 1]
        grows[: w - size - 1] += 2 * n[size + 1 : w] + 1  # the level it leaves for; a full window counts no more
        if size < w:
            grows[n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
            best = w - size - 1 - int(np.argmin(grows[::-1])) if len(grows) else -1
            if best >= 0 and grows[best] <= 2 * n[size] + 1:
                return best + 1
        return 0

    def add(self, doc_id: int, ids: bytes) -> list[tuple]:
        total, w, done = len(ids) // 4, self.window, []
        for start in range(0, total - total % w, w):
            done.append((doc_id, start, w, zlib.crc32(ids[4 * start : 4 * (start + w)]), total, self._sequence(), 0))
        size = total % w
        if size:
            level = self.level_for(size)
            held = self.stacks[level].pop() if level else []
            self.counts[level] -= level > 0
            held.append((doc_id, total - size, total, ids[4 * (total - size) :]))
            if level + size == w:
                done += self._rows(held)
            else:
                self.stacks[level + size].append(held)
                self.counts[level + size] += 1
        return done

    def _rows(self, held: list[tuple]) -> list[tuple]:
        out, at, sequence = [], 0, self._sequence()
        for doc_id, start, total, ids in held:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at))
            at += len(ids) // 4
        return out

    def close(self) -> list[tuple]:
        """Full windows from the open ones, fullest first, then powers of two from the last."""
        left = [held for level in range(self.window - 1, 0, -1) for held in self.stacks[level]]
        rest, done = [piece for held in left for piece in held][::-1], []
        todo = sum(len(p[3]) // 4 for p in rest)
        self.counts[:] = 0
        self.stacks = [[] for _ in range(self.window)]
        while todo:
            room = self.window if todo >= self.window else 1 << (todo.bit_length() - 1)
            todo -= room
            held = []
            while room:
                doc_id, start, total, ids = rest.pop()
                here = min(room, len(ids) // 4)
                held.append((doc_id, start, total, ids[: 4 * here]))
                if here < len(ids) // 4:
                    rest.append((doc_id, start + here, total, ids[4 * here :]))
                room -= here
            done += self._rows(held)
        return done


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` tokens; one row a piece.

    Every token of every document, its end mark included, lies in exactly one piece.
    A null or empty text is its end mark alone; a null doc_id stays null; a repeated
    row is packed again; an empty table gives no pieces.  ``sequence_id`` is unique
    over the table.  ``tokenizer`` is the path of its file on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, rows = WordIds(tokenizer), Packer(window, TaskContext.get().partitionId() << 40), []
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    rows += packer.add(doc_id, ids + end)
                if len(rows) >= 10_000:
                    yield _table(rows)
                    rows = []
        yield _table(rows + packer.close())

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
