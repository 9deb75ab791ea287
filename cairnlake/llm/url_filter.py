"""URL filter by a Bloom filter cascade (operator 7, DataFrame functions only).

Level 1 holds the listed keys.  Level 2 holds the keys of the corpus that pass
level 1 but are not listed, level 3 the listed keys that pass level 2, and so on
until a level lets nothing wrong through.  As the universe is every key that any
url of the corpus can be looked up by, the answer is exact, and looking a url up
needs no join: the levels are literals of the plan.

Sizes: a level of n keys takes ``BITS_PER_KEY * n`` bits.  Level 1 grows with the
rule list, the later ones with its false positives, each about 2 % of what the
level before was asked; none grows with the number of pages itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 8
HASHES = 4
MAX_LEVELS = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(size)) for i in range(HASHES)]


def _words(keys: DataFrame, level: int, size: int) -> list[int]:
    """The bit array of the level: one row a 64-bit word, OR-ed by the executors."""
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), level, size))).alias("bit"))
    got = bit.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).collect()
    words = [0] * (size // 64)
    for row in got:
        words[row["word"]] = row["mask"]
    return words


def _passes(key: Column, level: int, words: Sequence[int]) -> Column:
    held, out = F.lit(list(words)).cast("array<bigint>"), F.lit(True)
    for bit in _bits(key, level, 64 * len(words)):
        out = out & (F.getbit(F.element_at(held, (F.floor(bit / 64) + 1).cast("int")), bit % 64) == 1)
    return out


class Cascade:
    """Exact membership of ``key`` in ``listed``, for every key of ``universe``."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """``listed`` and ``universe`` have one string column ``key``; repeats and nulls don't matter."""
        self.levels: list[list[int]] = []
        listed = listed.where(F.col("key").isNotNull()).distinct()
        inside, outside = listed, None
        while True:
            level = len(self.levels)
            own = inside if level % 2 == 0 else outside
            n = own.count()
            if n == 0 and level:
                return
            if level >= MAX_LEVELS:
                raise RuntimeError("the cascade does not close")
            size = max(64, -(-n * BITS_PER_KEY // 64) * 64)
            words = _words(own, level, size)
            self.levels.append(words)
            if level == 0:
                # the only look at the whole universe: what passes level 1 is filtered before any shuffle
                outside = universe.where(F.col("key").isNotNull() & _passes(F.col("key"), 0, words)).distinct().join(listed, "key", "left_anti")
            elif level % 2:
                inside = inside.where(_passes(F.col("key"), level, words))
            else:
                outside = outside.where(_passes(F.col("key"), level, words))

    def contains(self, key: Column) -> Column:
        """True iff ``key`` is listed: the first level that stops a key tells on which side it is."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~_passes(key, level, self.levels[level]), F.lit(level % 2 == 1)).otherwise(out)
        return out


def _keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys a url can be listed under: every host suffix with the path's first n characters, longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """Judge each url by ``rules``: (action, host, path), the longest rule that fits wins.

    Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (the rule's
    action; ``default`` where the cascades list none of the url's keys).  Columns of
    those names are replaced.  A null url, or one without ``://``, has an empty host
    and path, fits no rule and gets the default.  An empty table gives an empty table.
    Repeated rows are judged each.
    """
    spark = pages.sparkSession
    for action, host, path in rules:
        if action not in ("allow", "block") or not host or not path.startswith("/"):
            raise ValueError(f"bad rule: {action} {host}{path}")
    lengths = sorted({len(path) for _, _, path in rules}, reverse=True)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    keys = _keys(host, path, lengths or [1])
    universe = pages.select(F.explode(keys).alias("key"))
    listed = {a: [(h + p,) for b, h, p in rules if a == b] for a in ("allow", "block")}
    cascades = {a: Cascade(spark.createDataFrame(rows, "key string"), universe) for a, rows in listed.items() if rows}
    hit = lambda x: F.coalesce(*[F.when(c.contains(x), F.lit(a)) for a, c in cascades.items()])
    if not cascades:
        best = F.lit(None).cast("struct<n:int,rule:string,action:string>")
    else:
        found = F.filter(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), hit(k).alias("action"))), lambda s: s["action"].isNotNull())
        best = F.array_max(found)
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"), best.alias("__best")).select(
        *[F.col(f"`{c}`") for c in rest], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict")
    )
