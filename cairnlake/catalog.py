"""The catalog: four DataFrames that operators read and, for changes, return anew."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import schema


@dataclass(frozen=True)
class Catalog:
    """``roots`` (few), ``sources`` (files), ``objects`` (contents) and ``facts`` (typed values).

    Immutable: a change gives a new catalog whose tables are lazy plans over the old ones.
    """

    roots: DataFrame
    sources: DataFrame
    objects: DataFrame
    facts: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.sources.sparkSession

    def with_(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    @staticmethod
    def of(roots: DataFrame, sources: DataFrame, objects: DataFrame, facts: DataFrame) -> Catalog:
        return Catalog(schema.conform(roots, schema.ROOTS), schema.conform(sources, schema.SOURCES), schema.conform(objects, schema.OBJECTS), schema.conform(facts, schema.FACTS))

    @staticmethod
    def empty(spark: SparkSession) -> Catalog:
        return Catalog(*[spark.createDataFrame([], s) for s in (schema.ROOTS, schema.SOURCES, schema.OBJECTS, schema.FACTS)])

    @staticmethod
    def load(spark: SparkSession, path: str) -> Catalog:
        """A saved snapshot.  Facts are laid out by key, so a filter reads its keys' folders only."""
        read = lambda name, s: spark.read.schema(s).parquet(f"{path}/{name}")
        return Catalog(read("roots", schema.ROOTS), read("sources", schema.SOURCES), read("objects", schema.OBJECTS), schema.conform(read("facts", schema.FACTS), schema.FACTS))

    def save(self, path: str) -> None:
        """Write a snapshot to a new folder; an interrupted write leaves no valid one behind, as ``roots`` comes last."""
        self.facts.repartition("key", F.pmod(F.hash("entity_id"), F.lit(16))).write.partitionBy("key").parquet(f"{path}/facts")
        self.objects.write.parquet(f"{path}/objects")
        self.sources.write.parquet(f"{path}/sources")
        self.roots.write.parquet(f"{path}/roots")

    def located(self) -> DataFrame:
        """Sources with ``root_path`` and ``role``; roots are a short list, kept by hand."""
        return self.sources.join(F.broadcast(self.roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"), "role")), "root_id")
