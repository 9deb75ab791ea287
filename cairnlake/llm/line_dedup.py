"""Line dedup by site-relative frequency (operator 10, DataFrame functions only).

A line is boilerplate of a host if the pages of the host that hold it, divided by
all pages of the host, exceed a ratio.  Only hashes of lines are shuffled, and the
counts are combined before they are; the texts stay where they are as long as the
hosts' lists of boilerplate, whose size is measured, are small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.runtime import materialise

RATIO = 0.1
MIN_PAGES = 2
SALTS = 32
BROADCAST_BYTES = 16 << 20


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines.

    A line that stands twice in a page counts once for it; blank lines never count.
    One that a single page holds is no repetition whatever its ratio (``min_pages``): else
    hosts of a few pages would lose all their text.
    There are at most (mean lines of a page / ratio) of them a host, so a list is bounded.
    """
    own = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("h"), F.col(text).alias("t"))
    totals = own.groupBy("h").agg(F.count("*").alias("pages"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.trim(x) != "")
    counts = own.select("h", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line")).groupBy("h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "h").where(F.col("n") / F.col("pages") > ratio)
    return often.groupBy("h").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def line_dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """Drop the boilerplate lines of each page's host from its text.

    ``pages`` with ``text`` replaced, ``n_lines`` (lines the page had) and
    ``n_dropped``.  A null text stays null with 0 lines; an empty one has one empty
    line, which is kept.  A null host is the host ``''``.  A repeated row is a page of
    its own, so on a host of few pages copies lose their common lines.  Columns named
    n_lines or n_dropped are replaced.
    """
    flagged = materialise(boilerplate(pages, ratio, min_pages, text, host).select(F.col("h").alias("__h"), F.col("lines").alias("__lines")), "boilerplate")
    size = flagged.agg(F.sum(64 + F.octet_length("__h") + 8 * F.size("__lines")).alias("bytes")).first()["bytes"] or 0
    rest = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    own = pages.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__h"))
    if size <= BROADCAST_BYTES:
        own = own.join(F.broadcast(flagged), "__h", "left")
    else:  # a hot host must not land in one task: its short list is dealt to several keys
        dealt = flagged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"), F.lit(0))).join(dealt, ["__h", "__salt"], "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), _key(x)) | (F.trim(x) == ""))
    kept = F.when(F.col("__lines").isNull(), lines).otherwise(kept)
    out = own.withColumn("__kept", kept)
    n = F.coalesce(F.size(lines), F.lit(0))
    return out.select(
        *[(F.when(F.col(text).isNotNull(), F.array_join("__kept", "\n")).alias(c) if c == text else F.col(f"`{c}`")) for c in rest],
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(n - F.size("__kept")).cast("long").alias("n_dropped"),
    )
