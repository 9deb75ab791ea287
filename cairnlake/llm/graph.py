"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.runtime import discard, materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b: two longs) the smallest node it is linked with.

    Nodes without an edge are not in it; loops, repeats and both directions are allowed.
    Neighbours are never gathered: a round takes minima, combined before they are shuffled.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state["n"], state["x"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        seen = (state["n"], state["x"])
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, large = now, materialise(large, "edges")
        discard(before)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(large)
    raise RuntimeError("the components do not settle")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a - b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new
