"""Schemas of the catalog and its invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOTS = "id long, path string, role string"
SOURCES = "id long, root_id long, rel_path string, device long, inode long, size long, mtime long, basis_rev long, scanned_at long, last_seen_at long, present long, object_id long"
OBJECTS = "id long, hash_type string, hash_value string"
FACTS = "entity_type string, entity_id long, key string, value_text string, value_num double, value_time long, value_json string, observed_at long, observed_basis_rev long"
VALUE_COLUMNS = ["value_text", "value_num", "value_time", "value_json"]


def columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, cast to its types."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in columns(schema)])


def violations(catalog) -> DataFrame:
    """(rule, n) for each rule of the data model that the catalog breaks; empty if it is sound."""

    def repeated(df: DataFrame, rule: str, *keys: str, where: str = "true") -> DataFrame:
        return df.where(where).groupBy(*keys).count().where("count > 1").agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    def broken(df: DataFrame, rule: str, where) -> DataFrame:
        return df.where(where).agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in VALUE_COLUMNS])
    rules = [
        repeated(catalog.roots, "root path unique", "path"),
        broken(catalog.roots, "root role", "role not in ('source', 'archive')"),
        repeated(catalog.sources, "source path unique", "root_id", "rel_path"),
        repeated(catalog.sources, "inode unique", "device", "inode", where="device is not null and inode is not null"),
        repeated(catalog.objects, "object hash unique", "hash_type", "hash_value"),
        repeated(catalog.facts, "fact unique", "entity_type", "entity_id", "key"),
        broken(catalog.facts, "entity type", "entity_type not in ('source', 'object')"),
        broken(catalog.facts, "one value", filled != 1),
        broken(catalog.facts, "revision of source facts only", "(entity_type = 'source') <> (observed_basis_rev is not null)"),
        broken(catalog.sources.join(catalog.roots.select(F.col("id").alias("root_id")), "root_id", "left_anti"), "source has a root", "true"),
    ]
    return reduce(DataFrame.unionByName, rules).where("n > 0")
