"""Suffix-array dedup of repeated byte strings (operator 5).

Removes each byte that a string of ``length`` bytes covers which also starts elsewhere
in the corpus.  Exact, and without a suffix array of the whole corpus:

1. Anchors (``anchors``) split all windows into runs.  Only grams met twice matter, and
   runs whose whole context is met twice are repeated without looking closer.
2. What is left, contexts that differ around a gram they share, is dealt by gram.
   Each shard sorts its suffixes by induction with disk-backed queues (``induced``);
   neighbours whose first ``length`` bytes agree are repeated.
3. A gram with more than ``HOT`` different contexts (a passage in a third of all
   documents) isn't sorted in one shard: its windows are counted by hash, combined
   before they are shuffled.  ``HOT`` contexts are about as many bytes as a shard holds.
4. The runs' windows are merged to spans per distinct text.

Exact copies are one text throughout.  Filters of fixed size tell the executors which
contexts to send, so texts are shuffled only where they lose something.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.anchors import content_ids, pieces, runs
from cairnlake.llm.induced import suffix_array
from cairnlake.llm.jaccard import Bloom
from cairnlake.llm.runtime import discard, materialise, trimmed
from cairnlake.llm.textbytes import Spans, mix

LENGTH = 400
HOT = 2048
SHARD_BYTES = 1 << 20
BITS = 1 << 25
BROADCAST_HASHES = 1_000_000


def _columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text")


def _cids(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, ids) of pieces with the texts that the task hasn't met yet."""
    seen: set[int] = set()
    for batch in batches:
        for _, part, off in pieces(batch.column(batch.schema.get_field_index("text"))):
            cids = _cids(content_ids(part, off))
            new = np.array([c not in seen and not seen.add(c) for c in cids.tolist()], bool)
            if not new.all():
                part = np.concatenate([part[off[i] : off[i + 1]] for i in np.flatnonzero(new)] + [part[:0]])
                off = np.concatenate([[0], np.cumsum(np.diff(off)[new])])
            yield part, off, cids[new]


def _token(cid, start):
    return cid ^ (start << 9)


def repeated_windows(contexts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each context whether the string at each of its windows also starts at another place of them all."""
    sizes = np.array([len(c) for c in contexts])
    text = np.zeros(int(sizes.sum()) + len(contexts), np.int16)  # a symbol below all bytes ends each context
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    for at, context in zip(starts.tolist(), contexts, strict=True):
        text[at : at + len(context)] = context
        text[at : at + len(context)] += 1
    order = suffix_array(text, length)
    whole = np.zeros(len(text), bool)
    for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        whole[at : at + size - length + 1] = True
    order = order[whole[order]]
    spans = Spans((text - 1).astype(np.uint8))
    hashes = mix(spans(order, order + length))
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    bytes_of = np.lib.stride_tricks.sliding_window_view(text, length)
    repeated = np.zeros(len(text), bool)
    for k in range(0, len(same), 4096):
        i = same[k : k + 4096]
        i = i[(bytes_of[order[i]] == bytes_of[order[i + 1]]).all(1)]
        repeated[order[i]] = repeated[order[i + 1]] = True
    return [repeated[at : at + size - length + 1] for at, size in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _spans_of(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans that runs of flagged windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, off, cids in _distinct_texts(batches):
            text, start, windows, gram, context = runs(part, off, length)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(cids[text]), pa.array(start), pa.array(windows)], names=["gram", "ctx", "cid", "start", "windows"])

    return _columns(docs).mapInArrow(trimmed(run), "gram long, ctx long, cid long, start long, windows long")


def _contexts(docs: DataFrame, length: int, wanted, hashed: bool) -> DataFrame:
    """The wanted runs: their bytes by gram, or a hash of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, off, cids in _distinct_texts(batches):
            text, start, windows, gram, _ = runs(part, off, length)
            asked = wanted.value.has(_token(cids[text], start).view(np.uint64)) if len(text) else np.zeros(0, bool)
            text, start, windows, gram = text[asked], start[asked], windows[asked], gram[asked]
            at = off[text] + start
            if hashed:
                which, hashes = _window_hashes(part, at, windows, length)
                step = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(cids[text][which]), pa.array(start[which] + step)], names=["hash", "cid", "start"])
            else:
                held = [part[a : a + w + length - 1].tobytes() for a, w in zip(at.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(cids[text]), pa.array(start), pa.array(held, pa.binary())], names=["gram", "cid", "start", "bytes"])

    return _columns(docs).mapInArrow(trimmed(run), "hash long, cid long, start long" if hashed else "gram long, cid long, start long, bytes binary")


def _window_hashes(part: np.ndarray, at: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, hash) of each window of runs that begin at ``at``."""
    which = np.repeat(np.arange(len(at)), windows)
    spot = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    return which, mix(Spans(part)(spot, spot + length), 9) if len(spot) else np.zeros(0, np.uint64)


def _hot_runs(docs: DataFrame, length: int, wanted, often: np.ndarray | None) -> DataFrame:
    """The wanted runs' window hashes, counted by task; or, given the sorted hashes that are met more than once, their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, off, cids in _distinct_texts(batches):
            text, start, windows, _, _ = runs(part, off, length)
            asked = wanted.value.has(_token(cids[text], start).view(np.uint64)) if len(text) else np.zeros(0, bool)
            text, start, windows = text[asked], start[asked], windows[asked]
            which, hashes = _window_hashes(part, off[text] + start, windows, length)
            if often is None:
                keys, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "n"])
            elif len(hashes) and len(often.value):
                again = often.value[np.minimum(np.searchsorted(often.value, hashes), len(often.value) - 1)] == hashes
                cuts = np.flatnonzero(np.diff(which)) + 1
                rows = [(int(cids[t]), a, b) for t, s, flags in zip(text.tolist(), start.tolist(), np.split(again, cuts), strict=True) for a, b in _spans_of(flags, s, length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["cid", "a", "b"])

    return _columns(docs).mapInArrow(trimmed(run), "hash long, n long" if often is None else "cid long, a long, b long")


def _sorted_shards(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            rows = []
            for (cid, start, _), flags in zip(held, repeated_windows([np.frombuffer(h[2], np.uint8) for h in held], length), strict=True):
                rows += [(cid, a, b) for a, b in _spans_of(flags, start, length)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["cid", "a", "b"])

        for batch in batches:
            for gram, cid, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram != last and size >= SHARD_BYTES:
                    yield solved()
                    size = 0
                held.append((cid, start, raw))
                size, last = size + len(raw), gram
        if held:
            yield solved()

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(trimmed(run), "cid long, a long, b long")


def _removed(docs: DataFrame, length: int, known, covered: bool) -> DataFrame:
    """Rows of documents by whether their text may lose something; texts go along only then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, off in pieces(batch.column(1)):
                digests = content_ids(part, off)
                cids = _cids(digests)
                rows = np.flatnonzero(known.value.has(cids.view(np.uint64)) == covered)
                ids = batch.column(0).slice(first, len(digests)).take(pa.array(rows))
                n = np.diff(off)[rows]
                if covered:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cids[rows]), _bytes(part, off, rows)], names=["doc_id", "cid", "bytes"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n), _span_lists([[]] * len(rows)), _bytes(part, off, rows)], names=_NAMES)

    return _columns(docs).mapInArrow(trimmed(run), "doc_id long, cid long, bytes binary" if covered else _SCHEMA)


_NAMES = ["doc_id", "n_bytes", "spans", "kept"]
_SCHEMA = "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary"


def _bytes(part: np.ndarray, off: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([part[off[r] : off[r + 1]].tobytes() for r in rows], pa.binary())


def _span_lists(lists: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for spans in lists for x in spans]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]) if lists else [0]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)], names=["a", "b"]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts, kept = [], []
        raws = batch.column(1).to_pylist()
        for raw, spans in zip(raws, batch.column(2).to_pylist(), strict=True):
            cut = merged([(s["a"], min(s["b"], len(raw))) for s in spans or () if s["a"] < len(raw)])
            edges = [0, *(x for span in cut for x in span), len(raw)]
            cuts.append(cut)
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), _span_lists(cuts), pa.array(kept, pa.binary())], names=_NAMES)


def substring_dedup(docs: DataFrame, length: int = LENGTH, hot: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes.  ``spans``: the maximal runs of removed bytes, from ``a`` to before
    ``b``; ``kept``: the remaining bytes, which may begin or end within a character.  Null and empty texts, and those under ``length`` bytes, lose
    nothing; every copy of a longer text loses all.  A repeated row is a copy.  ``hot``:
    contexts from which a gram's windows are counted instead of sorted.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, off in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_cids(content_ids(part, off))), pa.array(np.diff(off))], names=["cid", "n"])

    copies = _columns(docs).mapInArrow(trimmed(sizes), "cid long, n long").groupBy("cid").agg(F.count("*").alias("k"), F.max("n").alias("b")).where((F.col("k") > 1) & (F.col("b") >= length))
    spans = materialise(copies.select("cid", F.lit(0).cast("long").alias("a"), "b"), "copies")
    found = materialise(_anchors(docs, length), "anchors")
    grams = materialise(found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("n > 1").select("gram", "mixed"), "grams")
    live = materialise(found.join(grams, "gram"), "live")
    discard(found, grams)
    contexts = materialise(live.groupBy("gram", "ctx", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("cid", "start")).alias("rep")), "contexts")
    twice = materialise(contexts.where("n > 1").select("gram", "ctx"), "twice")
    whole = live.join(twice, ["gram", "ctx"]).select("cid", F.col("start").alias("a"), (F.col("start") + F.col("windows") - 1 + length).alias("b"))
    per_gram = materialise(contexts.where("mixed").groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("s")).where("s > 0").select("gram", "m"), "per-gram")
    least = HOT if hot is None else hot
    fetch = materialise(contexts.where("mixed").join(per_gram, "gram").select((F.col("m") > least).alias("hot"), F.col("rep.cid").bitwiseXOR(F.shiftleft("rep.start", 9)).alias("token")), "fetch")
    discard(contexts, per_gram)
    spans = spans.union(whole)
    if fetch.where("not hot").limit(1).count():
        cold = send(Bloom.of(fetch.where("not hot"), BITS))
        spans = spans.union(_sorted_shards(_contexts(docs, length, cold, False), length))
    if fetch.where("hot").limit(1).count():
        asked = send(Bloom.of(fetch.where("hot"), BITS))
        often = materialise(_hot_runs(docs, length, asked, None).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "often")
        if often.count() <= BROADCAST_HASHES:
            spans = spans.union(_hot_runs(docs, length, asked, send(np.sort(often.toArrow()["hash"].to_numpy().view(np.uint64)))))
        else:
            spans = spans.union(_contexts(docs, length, asked, True).join(often, "hash").select("cid", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    # spans of one text number less than its bytes
    cover = materialise(spans.distinct().groupBy("cid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "cover")
    discard(live, twice)
    known = send(Bloom.of(cover.select(F.col("cid").alias("token")), BITS))
    cut = _removed(docs, length, known, True).join(cover, "cid", "left").select("doc_id", "bytes", "spans").mapInArrow(trimmed(_cut), _SCHEMA)
    return cut.union(_removed(docs, length, known, False))
