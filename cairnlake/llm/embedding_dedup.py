"""Embedding near-duplicates by product quantisation (operator 6).

Index: coarse inverted lists (k-means on unit vectors), and for each vector the codes
of its residual in ``SUBSPACES`` subspaces.  The centroids are fitted on at most
``SAMPLE`` vectors, a parameter; every vector is indexed and asked.

Search: a vector asks the lists on whose side of the bisecting plane a partner can
lie.  A partner is at most ``delta`` away (chord of the cosine threshold), so planes
farther than ``delta`` can't matter; as a difference has no preferred direction, its
part along one plane's normal has a spread of ``delta / sqrt(dim)``, and planes within
``MARGIN`` of these spreads are asked.  In a list, distances come from one table a
query; a vector whose table distance exceeds ``delta`` by more than its own
quantisation error is no partner, the others get their exact cosine.

Bounds: lists are cut into blocks of ``BLOCK`` vectors, so a hot list is many tasks.  A
block gives its vectors' link counts and a spanning forest, never its pairs; equal
vectors are one, with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.graph import components, forest
from cairnlake.llm.runtime import materialise, trimmed

COSINE = 0.95
SAMPLE = 20_480
SUBSPACES = 8
CODES = 256
MAX_LISTS = 4096
MARGIN = 4.0
BLOCK = 1024
NAMELESS = 1 << 62  # from here on, ids of vectors that have none
_ROUNDS = 8


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distances to all) of each row."""
    d = (centres**2).sum(1) - 2 * x @ centres.T + (x**2).sum(1)[:, None]
    return d.argmin(1), d


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(_ROUNDS):
        at = np.concatenate([_nearest(x[i : i + 4096], centres)[0] for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Coarse centroids and, for each subspace, the residual's code book."""

    coarse: np.ndarray
    books: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, lists: int, subspaces: int = SUBSPACES) -> Index:
        coarse = _k_means(x, min(lists, len(x)), 1)
        rest = x - coarse[_nearest(x, coarse)[0]]
        parts = np.array_split(rest, min(subspaces, x.shape[1]), axis=1)
        return Index(coarse, [_k_means(np.ascontiguousarray(p), min(CODES, len(p)), 2 + i) for i, p in enumerate(parts)])

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each residual to what its codes stand for)."""
        codes, error, at = [], np.zeros(len(rest)), 0
        for book in self.books:
            part = rest[:, at : at + book.shape[1]]
            code, d = _nearest(part, book)
            codes.append(code.astype(np.uint8))
            error += np.maximum(d[np.arange(len(d)), code], 0)
            at += book.shape[1]
        return np.stack(codes, 1), np.sqrt(error)

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, whether each list is asked): lists whose bisecting plane with the own one is within ``margin``."""
        own, d = _nearest(x, self.coarse)
        gap = np.sqrt(np.maximum(_nearest(self.coarse, self.coarse)[1], 1e-18))
        ahead = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
        asked = ahead <= margin
        asked[np.arange(len(x)), own] = True
        return own, asked

    def table_distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of query residuals to coded residuals, by table lookup."""
        out, at = np.zeros((len(queries), len(codes)), np.float32), 0
        for k, book in enumerate(self.books):
            table = _nearest(queries[:, at : at + book.shape[1]], book)[1].astype(np.float32)
            out += table[:, codes[:, k]]
            at += book.shape[1]
        return np.sqrt(np.maximum(out, 0))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # else squares of very small or large components are lost
    return x / np.linalg.norm(x, axis=1)[:, None]


def _answer(index: Index, rows: pa.Table, dim: int, cosine: float) -> pa.Table:
    """Links between the queries and the members of one block pair: (id, links, root)."""
    delta = math.sqrt(2 - 2 * cosine)
    asks = np.asarray(rows["asks"])
    if not asks.any() or asks.all():
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    x, ids, weight, own = _units(rows["vector"].combine_chunks(), dim), np.asarray(rows["id"]), np.asarray(rows["weight"]), np.asarray(rows["own"])
    at = rows["list"][0].as_py()
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    codes = np.frombuffer(b"".join(rows["codes"].take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
    near = index.table_distances(x[q] - index.coarse[at], codes) <= delta + np.asarray(rows["error"])[m][None, :] + 1e-3
    near &= (own[q] < at)[:, None] | (ids[q][:, None] < ids[m][None, :])
    i, j = np.nonzero(near)
    kept = [np.zeros(0, bool)]
    for k in range(0, len(i), 50_000):
        kept.append(np.einsum("ij,ij->i", x[q[i[k : k + 50_000]]], x[m[j[k : k + 50_000]]]) >= cosine)
    kept = np.concatenate(kept)
    nodes, place = np.unique(np.concatenate([ids[q], ids[m]]), return_inverse=True)
    a, b = place[: len(q)][i[kept]], place[len(q) :][j[kept]]
    links = np.bincount(a, weight[m[j[kept]]], len(nodes)) + np.bincount(b, weight[q[i[kept]]], len(nodes))
    root = nodes[forest(a, b, len(nodes))]
    some = links > 0
    return pa.table({"id": pa.array(nodes[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some])})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, margin: float = MARGIN, lists: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Two vectors link when their cosine, in double precision, is at least ``cosine``;
    ``n_links`` counts the others linked directly, ``component_id`` is the smallest vec_id
    reachable, ``kept`` whether that is the vector itself.  A null, empty or zero vector,
    one with a null or non-finite component, and one of another length than its
    partners link with nothing.  A repeated row is a vector of its own.  A vector without
    a vec_id counts among its partners' links and takes part in their component, but
    never names it: without a named partner its component_id is null.
    """
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as vector")
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(good & F.exists("vector", lambda v: v != 0), F.lit(False))
    keyed = rows.select("vec_id", F.when(good, F.xxhash64("vector")).alias("k1"), F.when(good, F.xxhash64(F.lit(7), "vector")).alias("k2"), F.when(good, F.col("vector")).alias("vector"))
    nameless = F.first(F.col("k1").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    classes = materialise(keyed.where("vector is not null").groupBy("k1", "k2").agg(F.coalesce(F.min("vec_id"), nameless).alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "vectors")
    found = None
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()):
        one = _links(classes.where(F.size("vector") == dim), dim, n, cosine, sample, margin, lists)
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    found = materialise(found, "links")
    labels = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("k1", "k2", "id", "weight").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = materialise(known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c")).where("n > 0"), "known")
    out = keyed.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce(F.when(F.col("c") < NAMELESS, F.col("c")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))


def _links(classes: DataFrame, dim: int, n: int, cosine: float, sample: int, margin: float, lists: int | None) -> DataFrame:
    spark = classes.sparkSession
    got = classes.select("vector", F.xxhash64("k1", "k2").alias("h")).orderBy("h").limit(sample).select("vector").toArrow()
    lists = lists or max(1, min(MAX_LISTS, int(math.sqrt(n))))
    index = spark.sparkContext.broadcast(Index.fit(_units(got["vector"].combine_chunks(), dim), lists))
    reach = math.sqrt(2 - 2 * cosine) * min(1.0, margin / math.sqrt(dim))
    columns = ["id", "weight", "vector", "own", "list", "asks", "codes", "error"]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as a member of its list, and as a query of each list that it asks: its own and later ones."""
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                x = _units(part.column(2), dim)
                own, asked = index.value.probes(x, reach)
                codes, error = index.value.encode(x - index.value.coarse[own])
                asked &= np.arange(asked.shape[1])[None, :] >= own[:, None]
                i, at = np.nonzero(asked)
                row = np.concatenate([np.arange(len(x)), i])
                taken = part.take(pa.array(row))
                coded = pa.array([c.tobytes() for c in codes] + [b""] * len(i), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(own[row], pa.int32()), pa.array(np.concatenate([own, at]), pa.int32()), pa.array(np.concatenate([np.zeros(len(x), bool), np.ones(len(i), bool)])), coded, pa.array(np.concatenate([error, np.zeros(len(i))]))],
                    names=columns,
                )

    schema = "id long, weight long, vector array<double>, own int, list int, asks boolean, codes binary, error double"
    rows = materialise(classes.select("id", "weight", "vector").mapInArrow(trimmed(indexed), schema), "index")
    # at most MAX_LISTS rows: how many blocks the queries and the members of a list take
    counts = rows.groupBy("list").agg(F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("qs"), F.ceil(F.count_if(~F.col("asks")) / BLOCK).cast("int").alias("ms")).where("qs > 0 and ms > 0")
    rows = rows.join(F.broadcast(counts), "list")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("ms")).otherwise(F.col("qs")) - 1)))
    rows = rows.withColumn("q", F.when(F.col("asks"), mine("qs")).otherwise(F.col("other"))).withColumn("m", F.when(F.col("asks"), F.col("other")).otherwise(mine("ms")))

    def answer(rows: pa.Table) -> pa.Table:
        return _answer(index.value, rows, dim, cosine)

    return rows.select(*columns, "q", "m").groupBy("list", "q", "m").applyInArrow(answer, "id long, links long, root long")
