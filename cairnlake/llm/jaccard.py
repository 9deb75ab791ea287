"""N-gram Jaccard join with set-relation skipping (operator 3).

Exact: every pair of texts whose shingle sets reach the threshold ends in one
component.  Steps, each a distributed pass:

1. Equal sets are one class: the class id is a hash of the set, so a thousand
   copies cost one set from here on.
2. A global order of shingles: those met again within a task many times ("hot")
   last, else by hash.  A Bloom filter of fixed size says which are hot, so the
   order is the same everywhere; its errors change the order, never the result.
3. Index lists: a class stands in the lists of its first ``n - need + 1`` shingles,
   with its size and the shingle's position.  A second fixed-size Bloom filter of
   shingles that more than one class has keeps lists of one from being shuffled.
4. Skipping by position: an entry whose size and position bound the overlap below
   the need is skipped without looking at its set.
5. Set relations: each list is first answered for its leader, its smallest set.
   Members that link with the leader share its component, so nothing between them
   is looked at any more.  Only lists that still hold several components are asked
   again, and there the leader's distances decide most pairs: Jaccard distance is a
   metric, so d(x, y) >= |d(leader, x) - d(leader, y)|.
   Pairs are not made rows: an open list is cut into blocks, a pair is looked at in
   the list of its first common shingle, and a block gives a spanning forest of what
   parity sketches of fixed size can't rule out.  The trees of that forest are small
   groups, whose sets meet in blocks, where what is not linked yet is compared
   exactly; a block gives a spanning forest again.
6. Leaders' pairs are compared by the sketches first, which rule out only what can't
   link, then by their sets.

The sets themselves are only built again for classes that the sketches leave.
Filters are sized by a count; beyond ``MOST_BITS`` they only let more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.graph import components, forest
from cairnlake.llm.runtime import discard, materialise, trimmed
from cairnlake.llm.textbytes import LOWER, SPACES, Spans, chunks, mix, shingles, utf8, word_spans

HOT_COUNT = 12
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29
SKETCH_BITS = 2048
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
FIRST = 3
PAIRS = 500_000


class Bloom:
    """A filter of bounded size over 64-bit hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def sized(keys: DataFrame, column: str = "token") -> Bloom:
        """With 16 bits a key, ``MOST_BITS`` at most; ``keys`` are read twice."""
        return Bloom.of(keys, min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length())), column)

    @staticmethod
    def of(keys: DataFrame, bits: int, column: str = "token") -> Bloom:
        """The executors OR the bits; the driver gets ``bits / 64`` longs at most."""
        spots = keys.select(F.explode(F.array(F.pmod(F.col(column), F.lit(bits)), F.pmod(F.shiftright(F.col(column), 29), F.lit(bits)))).alias("s"))
        got = spots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[got["w"].to_numpy()] = got["m"].to_numpy()
        return Bloom(words)

    def has(self, tokens: np.ndarray) -> np.ndarray:
        bits, signed = 64 * len(self.words), tokens.view(np.int64)
        out = np.ones(len(tokens), bool)
        for spot in (signed & (bits - 1), (signed >> 29) & (bits - 1)):
            out &= (self.words[spot >> 6] >> (spot & 63)) & 1 == 1
        return out


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, shingles, first shingle of each text), each text's sorted and distinct."""
    raw, offsets = utf8(texts)
    for first, end, part, off in chunks(raw, offsets):
        low = LOWER[part]
        starts, ends, at = word_spans(SPACES[low], off)
        got, bounds = shingles(mix(Spans(low)(starts, ends)), at, size)
        which = np.repeat(np.arange(end - first), np.diff(bounds))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # many short sorts beat a long one
            got[a:b].sort()
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (which[1:] != which[:-1])
        got, which = got[new], which[new]
        yield first, end, got, np.searchsorted(which, np.arange(end - first + 1))


def class_ids(got: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(got, 11), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(got: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity sketches of sets of sorted shingles: each shingle turns one bit of its set's row."""
    out = np.zeros((len(at) - 1) * (SKETCH_BITS // 64), np.uint64)
    if len(got):
        spot = (got >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
        place = np.repeat(np.arange(len(at) - 1) * (SKETCH_BITS // 64), np.diff(at)) + (spot >> 6)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out[place[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (spot & 63).astype(np.uint64), first)
    return out.reshape(len(at) - 1, -1)


def need(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap of sets of sizes a and b with ``den * overlap >= num * union``."""
    return F.ceil(F.lit(num) * (a + b) / F.lit(num + den)).cast("long")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``key``, by which a row's set is asked for: its doc_id, or a hash of its text where that is null."""
    return _columns(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def _class_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, cid, key, sketch) of each row; a class has its sketch once a task, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for first, end, got, at in sets_of(batch.column(1), size):
                cids, n = class_ids(got, at), np.diff(at)
                new = _new_classes(cids, seen) & (n > 0)
                bits = sketches(got, at)[new].view(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new * bits.shape[1])]), pa.int32()), pa.array(bits.ravel()), mask=pa.array(~new))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(cids), batch.column(2).slice(first, end - first), column], names=["doc_id", "n", "cid", "key", "sketch"])

    return _keyed(docs).mapInArrow(trimmed(run), "doc_id long, n long, cid long, key long, sketch array<long>")


def _prefix_lengths(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * num // den) + 1, 0)


def _new_classes(cids: np.ndarray, seen: set) -> np.ndarray:
    out = np.zeros(len(cids), bool)
    for i, c in enumerate(cids.tolist()):
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _hot(docs: DataFrame, size: int, num: int, den: int) -> Bloom:
    """Shingles that tasks meet again and again among the smallest hashes of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, got, at in sets_of(batch.column(1), size):
                n = np.diff(at)
                take = np.where(_new_classes(class_ids(got, at), seen), np.minimum(n, 2 * _prefix_lengths(n, num, den) + 8), 0)
                index = np.repeat(at[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                new, times = np.unique(np.concatenate([keys, got[index]]), return_inverse=True)
                counts = np.bincount(times, np.concatenate([counts, np.ones(len(index))]), len(new)).astype(np.int64) if len(new) else counts
                keys = new
                if len(keys) > 1_000_000:  # rare ones go; only the order depends on it
                    keys, counts = keys[counts > 1], counts[counts > 1]
        often = counts > 1
        for k in range(0, int(often.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[often][k : k + 100_000].view(np.int64)), pa.array(counts[often][k : k + 100_000])], names=["token", "n"])

    return Bloom.sized(materialise(_columns(docs).mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT).select("token"), "hot"))


def _entries(docs: DataFrame, size: int, num: int, den: int, hot, only=None) -> DataFrame:
    """The entries of the index lists: (token, cid, n, pos), a class once a task; ``only``: lists to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, _, got, at in sets_of(batch.column(1), size):
                n, cids = np.diff(at), class_ids(got, at)
                take = np.where(_new_classes(cids, seen), _prefix_lengths(n, num, den), 0)
                late = hot.value.has(got)
                which = np.repeat(np.arange(len(n)), n)
                before = np.concatenate([np.zeros(1, np.int64), np.cumsum(late)])
                lates = before[1:] - before[at[which]]  # of the set, up to here
                spot = np.where(late, at[which + 1] - (before[at[1:]] - before[at[:-1]])[which] + lates - 1, np.arange(len(got)) - lates)
                order = np.empty(len(got), np.int64)
                order[spot] = np.arange(len(got))
                index = np.repeat(at[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                tokens, owner = got[order[index]], np.repeat(np.arange(len(n)), take)
                pos = index - at[owner]
                if only is not None:
                    kept = only.value.has(tokens)
                    tokens, owner, pos = tokens[kept], owner[kept], pos[kept]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(cids[owner]), pa.array(n[owner]), pa.array(pos)], names=["token", "cid", "n", "pos"])

    return _columns(docs).mapInArrow(trimmed(run), "token long, cid long, n long, pos long")


def _sets(docs: DataFrame, size: int, wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """(cid, tokens) of the classes ``wanted`` (cid), and of a few more."""
    keys = materialise(wanted.join(reps.select("cid", "key"), "cid").select("key"), "keys")
    asked = docs.sparkSession.sparkContext.broadcast(Bloom.sized(keys, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(asked.value.has(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))
            for _, _, got, at in sets_of(part.column(1), size) if len(part) else ():
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(got, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got.view(np.int64)))], names=["cid", "tokens"])

    sets = _keyed(docs).mapInArrow(trimmed(run), "cid long, tokens array<long>")
    return materialise(_once(sets, reps), "sets")


def _once(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``sets``, a class once: copies without ids share a key, so where there are such classes they are dealt by class."""
    return sets.dropDuplicates(["cid"]) if reps.where("least is null").limit(1).count() else sets


def _fits(an: str, ap: str, bn: str, bp: str, num: int, den: int) -> Column:
    """Whether sizes and positions of a common shingle leave room for the needed overlap."""
    a, i, b, j = map(F.col, (an, ap, bn, bp))
    return (F.least(i, j) + 1 + F.least(a - i, b - j) - 1) >= need(a, b, num, den)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(a, b, both, an, bn): the pairs that may link, with the overlap and sizes of their sets.

    Parity sketches go first: each shingle that only one of two sets has changes one
    bit, so more different bits than a link leaves room for rule a pair out.
    """
    pairs = materialise(pairs, "pairs")
    one = pairs.join(reps.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("s")), "a")
    two = one.join(reps.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("t")), "b")
    apart = F.aggregate(F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    left = materialise(two.where(apart <= F.col("an") + F.col("bn") - 2 * need(F.col("an"), F.col("bn"), num, den)).select("a", "b").distinct(), "pairs")
    discard(pairs)
    sets = _sets(docs, size, left.select(F.col("a").alias("cid")).union(left.select("b")).distinct(), reps)
    one = left.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("s")), "a")
    two = one.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("t")), "b")
    out = materialise(two.select("a", "b", F.size(F.array_intersect("s", "t")).cast("long").alias("both"), F.size("s").cast("long").alias("an"), F.size("t").cast("long").alias("bn")), "verified")
    discard(left, sets)
    return out


def _apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of different bits of rows i and j of sketches."""
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[i[k : k + 20_000]] ^ bits[j[k : k + 20_000]]).sum(1, dtype=np.int64) for k in range(0, len(i), 20_000))])


def _paired(rows: DataFrame, blocks: str, *keys: str) -> DataFrame:
    """Each row once for each pair (p, q) of blocks that its own (``block``) is in, of ``blocks`` blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", blocks)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the first and of the second block of a group, and whether it is one block."""
    block, p, q = np.asarray(group["block"]), group["p"][0].as_py(), group["q"][0].as_py()
    return (np.arange(len(block)), np.arange(len(block)), True) if p == q else (np.flatnonzero(block == p), np.flatnonzero(block == q), False)


def _near_in_lists(reps: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): a forest whose trees hold together what may link across components within the open lists."""
    rows = known.select("token", "cid", "n", "pos", "component", "d", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    # a class's first lists: a pair that shares one of them is looked at there
    firsts = known.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, FIRST).alias("firsts"))
    rows = rows.join(firsts, "cid").join(reps.select("cid", "sketch"), "cid")
    early = [F.coalesce(F.when(F.get("firsts", F.lit(k))["pos"] < F.col("pos"), F.get("firsts", F.lit(k))["token"]), F.lit(0)).alias(f"f{k}") for k in range(FIRST)]
    rows = _paired(rows.select("token", "cid", "n", "pos", "component", "d", "blocks", "sketch", *early), "blocks")

    longs = ["token", "p", "q", "block", "cid", "n", "pos", "component", *(f"f{k}" for k in range(FIRST))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of (token, p, q), some thousands of rows at a time."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).combine_chunks()
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if len(rows) < 4096:
                rest = rows
                continue
            keys = [np.asarray(rows[c]) for c in ("token", "p", "q")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            whole = int(new[-1]) if len(new) else 0
            if whole:
                yield solved(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and len(rest):
            yield solved(rest)

    def solved(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        token, p, q, block, cid, n, pos, component, *earlier = (np.asarray(rows[c]).astype(np.int64) for c in longs)
        distance = rows["d"].combine_chunks().to_numpy(zero_copy_only=False)
        flat = rows["sketch"].combine_chunks()
        bits = np.asarray((flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten()).view(np.uint64).reshape(len(cid), -1)
        at = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, [len(cid)]])
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # a row's partners are the rows after it; with two blocks, those of the second
        second = at[:-1] + np.add.reduceat((block == p).astype(np.int64), at[:-1])
        low = np.where(p == q, np.arange(len(cid)) + 1, np.where(block == p, second[group], at[1:][group]))
        count = at[1:][group] - low
        label, ends = np.arange(len(cid)), np.concatenate([[0], np.cumsum(count)])
        first = 0
        while first < len(cid):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PAIRS, "right")) - 1)
            c = count[first:last]
            i = np.repeat(np.arange(first, last), c)
            j = np.arange(len(i)) - np.repeat(ends[first:last] - ends[first], c) + low[i]
            first = last
            i, j = _kept(i, j, (component[i] != component[j]) & (label[i] != label[j]))
            least = -(-num * (n[i] + n[j]) // (num + den))
            # as the first common shingle of a pair that links, it leaves that much after it
            fits = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least) & ~(np.abs(distance[i] - distance[j]) > 1 - num / den + 1e-9)
            i, j, room = _kept(i, j, fits, n[i] + n[j] - 2 * least)
            for x in earlier:
                for y in earlier:
                    i, j, room = _kept(i, j, (x[i] != y[j]) | (x[i] == 0), room)
            i, j = _kept(i, j, _apart(bits, i, j) <= room)
            if len(i):
                label = forest(label[i], label[j], len(cid))[label]
        moved = label != np.arange(len(cid))
        return pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[label[moved]])], names=["x", "y"])

    return rows.select(*longs, "d", "sketch").repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", F.col("block") != F.col("p")).mapInArrow(trimmed(near), "x long, y long")


def _kept(i: np.ndarray, j: np.ndarray, mask: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    return (i, j, *more) if mask.all() else tuple(x[mask] for x in (i, j, *more))


def _linked_in_trees(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): a forest of links, exactly, among the classes of each tree; ``sets`` (tree, cid, component, tokens)."""
    sizes = sets.groupBy("tree").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("tokens").cast("long")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = _paired(sets.join(sizes, "tree"), "blocks")

    def linked(group: pa.Table) -> pa.Table:
        cid, component = np.asarray(group["cid"]), np.asarray(group["component"])
        held = group["tokens"].combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        at = np.asarray(held.offsets).astype(np.int64)
        tokens = np.asarray(held.values).view(np.uint64)[at[0] : at[-1]]
        at = at - at[0]
        n, bits = np.diff(at), sketches(tokens, at)
        left, right, alone = _sides(group)
        label = np.unique(component, return_index=True, return_inverse=True)
        label = label[1][label[2]]
        top = label.tolist()

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for k in range(0, len(left), 128):
            now = np.array([root(i) for i in range(len(top))])
            a, b = left[k : k + 128, None], right[None, :]
            ok = (now[a] != now[b]) & (np.minimum(n[a], n[b]) >= -(-num * (n[a] + n[b]) // (num + den)))
            if alone:
                ok &= a < b
            i, j = np.nonzero(ok)
            i, j = left[k + i], right[j]
            room = n[i] + n[j] - 2 * -(-num * (n[i] + n[j]) // (num + den)) - _apart(bits, i, j)
            order = np.argsort(-room, kind="stable")[: int((room >= 0).sum())]
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                p, q = root(x), root(y)
                if p == q:
                    continue
                s, t = tokens[at[x] : at[x + 1]], tokens[at[y] : at[y + 1]]
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if both * (num + den) >= num * (len(s) + len(t)):
                    top[max(p, q)] = min(p, q)
        end = np.array([root(i) for i in range(len(top))])
        moved = end != label
        return pa.table({"x": pa.array(cid[label[moved]], pa.int64()), "y": pa.array(cid[end[moved]], pa.int64())})

    return rows.groupBy("tree", "p", "q").applyInArrow(linked, "x long, y long")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Words are runs without space and TAB to CR, A-Z lower-cased; a set holds the
    distinct shingles of ``size`` words, the whole sequence where there are fewer.
    Two documents link when ``den * intersection >= num * union``; ``component_id`` is
    the smallest doc_id reachable by links.  A null text, and one without words, has
    no shingles and links with nothing.  Rows repeated with one id are one document.
    A null doc_id is part of its component and never names it; alone, it gets a null.
    """
    spark = docs.sparkSession
    rows = materialise(_class_rows(docs, size), "classes")
    reps = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.count("*").alias("k"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch"))
    reps = materialise(reps, "reps")
    hot = spark.sparkContext.broadcast(_hot(docs, size, num, den))
    shared = materialise(_entries(docs, size, num, den, hot).groupBy("token").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y").select("token"), "shared")
    only = spark.sparkContext.broadcast(Bloom.sized(shared))
    entries = materialise(_entries(docs, size, num, den, hot, only).groupBy("token", "cid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "entries")
    lead = entries.groupBy("token").agg(F.min(F.struct("n", "cid", "pos")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("token", "c", F.col("lead.cid").alias("a"), F.col("lead.n").alias("an"), F.col("lead.pos").alias("ai"))
    lead = materialise(lead, "leaders")
    lists = entries.join(lead, "token")
    pairs = lists.where("cid <> a").where(_fits("an", "ai", "n", "pos", num, den)).select("a", F.col("cid").alias("b")).distinct()
    first = _verified(docs, reps, pairs, size, num, den)
    linked = F.col("both") * (den + num) >= (F.col("an") + F.col("bn")) * num
    edges = first.where(linked).select("a", "b")
    labels = materialise(components(edges), "labels")

    # lists of several components beside the leader, whose distances stand for what is known of them
    known = lists.select("token", "c", "a", "cid", "n", "pos").join(first.select("a", F.col("b").alias("cid"), (1 - F.col("both") / (F.col("an") + F.col("bn") - F.col("both"))).alias("d")), ["a", "cid"], "left")
    known = known.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")).where("c > 2 and cid <> a")
    open_lists = known.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("token")
    known = materialise(known.join(open_lists, "token", "left_semi"), "open")
    discard(entries, lead, shared)
    maybe = materialise(_near_in_lists(reps, known, num, den).distinct(), "maybe")
    discard(known)
    if maybe.limit(1).count():
        trees = materialise(components(maybe.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("cid"), F.col("component").alias("tree")), "trees")
        trees = trees.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        sets = _sets(docs, size, trees.select("cid"), reps)
        more = materialise(_linked_in_trees(sets.join(trees, "cid"), num, den), "linked")
        discard(sets)
        if more.limit(1).count():
            labels = materialise(components(edges.union(more)), "labels")

    least = reps.join(labels.withColumnRenamed("node", "cid"), "cid", "left").where("k > 1 or component is not null").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    least = materialise(least, "members")
    named = materialise(least.select("cid", "component").join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cid", "component_id"), "named")
    out = rows.select("doc_id", "n", "cid").withColumn("key", F.when(F.col("n") > 0, F.col("cid"))).join(named.withColumnRenamed("cid", "key"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
