"""A small catalog of edge cases with hand-derived answers."""

from __future__ import annotations

from cairnlake import schema
from cairnlake.catalog import Catalog

ROOTS = [(1, "/r/a", "source"), (2, "/r/a_b", "source"), (3, "/v/x", "archive")]
SOURCES = [
    (1, 1, "p/IMG.JPG", 1, 11, 1000, 1705276800, 0, 0, 0, 1, 100),
    (2, 1, "p/.bashrc", None, None, 1024, 0, 0, 0, 0, 1, None),
    (3, 1, "p.old/arc.tar.gz", 1, 13, 1048576, -1, 1, 0, 0, 1, 101),
    (4, 2, "p/é.png", 1, 14, 5, 1705276800, 0, 0, 0, 1, 100),
    (5, 3, "keep/IMG.JPG", 1, 15, 1000, 1705276800, 0, 0, 0, 1, 100),
    (6, 1, "gone.txt", 1, 16, 1, 0, 0, 0, 0, 0, 100),
    (7, 3, "other.bin", 1, 17, 9, 0, 0, 0, 0, 1, 102),
]
OBJECTS = [(100, "sha256", "aa"), (101, "sha256", "bb"), (102, "sha256", "zz")]


def fact(kind, entity, key, text=None, num=None, time=None, json=None, rev=None):
    return (kind, entity, key, text, num, time, json, 0, rev if kind == "object" else (rev or 0))


FACTS = [
    fact("object", 100, "content.hash.sha256", "aa"),
    fact("object", 100, "content.Make", "Apple"),
    fact("object", 100, "content.n", num=3.0),
    fact("object", 101, "content.hash.sha256", "bb"),
    fact("object", 101, "content.shot", time=1705276800),
    fact("object", 101, "content.tags", json="[1]"),
    fact("object", 102, "content.hash.sha256", "zz"),
    fact("source", 1, "content.Make", "Nikon"),
    fact("source", 1, "content.code", "100"),
    fact("source", 2, "policy.exclude", "true"),
    fact("source", 2, "content.city", "É"),
    fact("source", 3, "content.note", ""),
]


def catalog(spark) -> Catalog:
    make = spark.createDataFrame
    return Catalog.of(make(ROOTS, schema.ROOTS), make(SOURCES, schema.SOURCES), make(OBJECTS, schema.OBJECTS), make(FACTS, schema.FACTS))
