"""Benchmark decontamination by SimHash windows (operator 4, DataFrame functions only).

1. One pass over the texts, without a shuffle.  Every ``stride``-th shingle of a text
   is looked up in a Bloom literal of the benchmark's shingles; only texts with a hit
   go on.  The stride loses nothing: a window near enough to an item leaves so few
   shingles unshared that some run of shared ones is at least that long.
2. All windows as long as the item that hold a hit get a 64-bit SimHash of their
   shingles, each weighted by how often it occurs.
3. Multi-index Hamming search: ``RADIUS + 1`` blocks of bits, so two fingerprints within
   the radius agree on one block at least.  Windows meet the items that have the same
   length and agree on a block; the whole distance then decides.
4. The weighted Jaccard similarity of the two multisets of shingles, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.runtime import held, materialise

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BROADCAST_ROWS = 200_000
MAX_BLOOM_WORDS = 1 << 17

_BLOCKS = [(64 * k // (RADIUS + 1), 64 * (k + 1) // (RADIUS + 1)) for k in range(RADIUS + 1)]
MOST_SHORT = 65_535


def _spread(width: int) -> list[int]:
    """For each value of as many bits as counters of ``width`` bits fit a long, a long with a one in the counters of its set bits."""
    own = [sum(1 << (width * j) for j in range(64 // width) if v >> j & 1) for v in range(1 << 64 // width)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in own]


def cleaned(text: Column) -> Column:
    """Lower-case runs of letters and digits, a space between them; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def _split(clean: Column) -> Column:
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return _split(cleaned(text))


def _shingle(words: Column, at: Column) -> Column:
    """Hash of the shingle from word ``at`` (0 the first)."""
    return F.xxhash64(F.slice(words, at + 1, F.lit(SHINGLE)))


def _run_of(words: Column, k: int):
    return lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice(words, p + 1, F.lit(k))).alias("h"))


def _shingles(words: Column) -> Column:
    """All shingles of ``words``; all words as one where they are fewer."""
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: _shingle(words, i))).otherwise(F.array().cast("array<bigint>"))


def _sums(h: Column, width: int) -> Column:
    """How often each of the 64 bits is set in the hashes: counters of ``width`` bits, as many as fit in each sum."""
    spread, per = F.lit(_spread(width)).cast("array<bigint>"), 64 // width
    digit = lambda x, k: (F.call_function("shiftrightunsigned", x, per * k).bitwiseAND(F.lit((1 << per) - 1)) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.call_function("try_add", acc, F.element_at(spread, digit(x, k)))))


def _fingerprinted(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """``df`` with the SimHash of ``hashes``: counters of 16 bits, of 32 for more than ``MOST_SHORT`` hashes."""
    h, short = F.col(hashes), F.size(hashes) <= MOST_SHORT
    df, s = held(df, "__sums", F.when(short, _sums(h, 16)).otherwise(_sums(h, 32))), F.col("__sums")

    def over(b: int, width: int) -> Column:
        per = 64 // width
        return 2 * F.shiftrightunsigned(F.element_at(s, b // per + 1), width * (b % per)).bitwiseAND(F.lit((1 << width) - 1)) > F.size(h)

    out = F.lit(0).cast("long")
    for b in range(64):
        set_ = F.when(short, over(b, 16)).otherwise(over(b, 32))
        out = out.bitwiseOR(F.when(set_, F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0).cast("long")))
    return df.withColumn(name, out).drop("__sums")


def _counted(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """``df`` with each element and the number of equal ones before it, so that sets of them are multisets."""
    df = held(df, "__order", F.array_sort(hashes))
    order = F.col("__order")
    before = lambda h, i: F.when(F.get(order, i - 1) == h, i - F.array_position(order, h) + 1).otherwise(F.lit(0).cast("long"))  # noqa: E731  most have none
    return df.withColumn(name, F.transform(order, lambda h, i: F.struct(h.alias("h"), before(h, i).alias("k")))).drop("__order")


def _bloom(item_shingles: DataFrame) -> list[int]:
    n = item_shingles.count()
    words = min(MAX_BLOOM_WORDS, max(64, 1 << (n // 4).bit_length()))
    got = item_shingles.select(F.explode(_spots(F.col("h"), words)).alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")).collect()
    out = [0] * words
    for row in got:
        out[row["w"]] = row["m"]
    return out


def _spots(h: Column, words: int) -> Column:
    return F.array(F.pmod(h, F.lit(64 * words)), F.pmod(F.shiftright(h, 31), F.lit(64 * words)))


def stride_for(shingle_counts: list[int], threshold: float = THRESHOLD) -> int:
    """A run of shared shingles that long is in every window near enough to an item of any of these sizes."""
    least = []
    for m in shingle_counts:
        # a window has at most as many shingles as the item; those it doesn't share are fewest when it has as many
        miss = int(m * (1 - threshold) / (1 + threshold) + 1e-9)
        least.append(-(-(m - miss) // (miss + 1)))
    return max(1, min(least, default=1))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, position): each document with each item it holds.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text).  ``similarity`` is the largest
    weighted 5-word-shingle Jaccard similarity of the item and a window of as many words
    (fewer at the text's end), at least ``threshold``; ``position`` is the first word of
    the first such window.  Null and empty texts and items match nothing; an item of
    fewer words than a shingle is one shingle.  Repeated rows give one result; a null
    doc_id or item_id is an id like others.  ``exact``: every window that shares a probed
    shingle with an item is compared with it, whatever their fingerprints, so that none
    is missed.
    """
    spark = docs.sparkSession
    items = held(benchmark.select("item_id", "text"), "words", words_of(F.col("text"))).where(F.size("words") > 0).select("item_id", F.size("words").alias("n"), _shingles(F.col("words")).alias("items")).distinct()
    items = materialise(_counted(_fingerprinted(items, "items", "item_fp"), "items", "item_set").withColumn("item", F.monotonically_increasing_id()), "items")
    offsets = items.select("item", "n", F.size("items").alias("m"), F.posexplode("items").alias("offset", "h"))
    sizes = [r["m"] for r in offsets.select("m").distinct().collect()]
    n_items, n_offsets = items.count(), offsets.count()
    stride, short = stride_for(sizes, threshold), items.where(F.col("n") < SHINGLE).limit(1).count() > 0
    if not n_items:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, position int")
    bloom = _bloom(offsets.select("h").distinct())
    bits = F.lit(bloom).cast("array<bigint>")

    def maybe(h: Column) -> Column:
        spots = [F.pmod(h, F.lit(64 * len(bloom))), F.pmod(F.shiftright(h, 31), F.lit(64 * len(bloom)))]
        return (F.getbit(F.element_at(bits, (F.shiftright(spots[0], 6) + 1).cast("int")), spots[0] % 64) == 1) & (F.getbit(F.element_at(bits, (F.shiftright(spots[1], 6) + 1).cast("int")), spots[1] % 64) == 1)

    words, hit = F.col("words"), lambda p: F.struct(p.alias("p"), _shingle(words, p).alias("h"))
    hits = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)), F.lit(stride)), hit), lambda s: maybe(s["h"]))
    if short:  # items of fewer words than a shingle: every run of as many words
        for k in sorted({r["n"] for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect()}):
            runs = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), _run_of(words, k))).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))
            hits = F.concat(hits, F.filter(runs, lambda s: maybe(s["h"])))
    near = held(docs.select("doc_id", "text"), "clean", cleaned(F.col("text"))).where("clean <> ''").select("doc_id", "clean")
    near = held(held(near, "words", _split(F.col("clean"))), "hits", hits).where(F.size("hits") > 0).select("doc_id", "clean", "hits")  # words take several times the space
    near = materialise(near.withColumn("row", F.monotonically_increasing_id()), "near")

    # every start whose window of the item's length holds a hit: parts of an item may have changed places
    of = ["n", "item"] if exact else ["n"]
    spots = near.select("row", F.explode("hits").alias("hit")).select("row", "hit.p", "hit.h").join(_small(offsets.select("h", *of).distinct(), n_offsets), "h")
    spots = spots.groupBy("row", *of).agg(F.collect_set("p").alias("ps"))
    span = lambda p: F.sequence(F.greatest(p - F.col("n") + F.least("n", F.lit(SHINGLE)), F.lit(0)), p)
    starts = held(spots.join(near.select("row", "clean"), "row"), "words", _split(F.col("clean"))).select("row", *of, "words", F.explode(F.array_distinct(F.flatten(F.transform("ps", span)))).alias("start"))
    count = lambda n: F.greatest(n - SHINGLE + 1, F.lit(1))  # noqa: E731  shingles of n words
    starts = starts.where(count(F.least("n", F.size("words") - F.col("start"))) >= count(F.col("n")) * threshold - 1e-9)  # at the text's end, too short ones are no match

    def hashed(starts: DataFrame) -> DataFrame:
        return held(held(starts, "window", F.slice(F.col("words"), F.col("start") + 1, F.col("n"))).drop("words"), "hashes", _shingles(F.col("window"))).drop("window")

    def blocks(fp: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(_BLOCKS)])

    if exact:
        checked = hashed(starts).join(near.select("row", "doc_id"), "row")
    else:
        windows = materialise(_fingerprinted(hashed(starts), "hashes", "fp").select("row", "n", "start", "fp"), "windows")
        left = windows.select("row", "n", "start", "fp", F.explode(blocks(F.col("fp"))).alias("block"))
        right = items.select("item", "n", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("block"))
        pairs = left.join(_small(right, len(_BLOCKS) * n_items), ["n", "block"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("row", "n", "start", "item").distinct()
        checked = hashed(held(pairs.join(near.select("row", "doc_id", "clean"), "row"), "words", _split(F.col("clean"))).drop("clean"))
    checked = checked.join(_small(items.select("item", "item_id", "items", "item_set"), n_items), "item")
    checked = _counted(checked, "hashes", "window_set")
    both = F.size(F.array_intersect("window_set", "item_set"))
    checked = checked.select("doc_id", "item_id", "start", (both / (F.size("hashes") + F.size("items") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("position"))
