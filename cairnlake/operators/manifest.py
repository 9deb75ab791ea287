"""Manifests: which files to copy where, and what stands against it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.functions import values
from cairnlake.functions.patterns import expand
from cairnlake.operators import scope as scopes


@dataclass(frozen=True)
class Manifest:
    """``sources``: id, root_id, path, size, object_id, hash_type, hash_value, facts (key to JSON text)."""

    sources: DataFrame
    archived: DataFrame
    excluded: DataFrame
    query: Sequence[str] = ()
    pattern: str = "{filename}"
    archive_root_id: int | None = None
    base_dir: str = ""
    meta: dict = field(default_factory=dict)


def archive_copies(catalog: Catalog, first_root: int | None = None) -> DataFrame:
    """(hash_value, archive_root, archive_path): one archive copy of each content.

    A copy in ``first_root`` goes before others, then the smallest root path and path.
    """
    held = catalog.located().where("role = 'archive' and present = 1 and object_id is not null").join(catalog.objects.select(F.col("id").alias("object_id"), "hash_value"), "object_id")
    first = F.lit(0) if first_root is None else (F.col("root_id") != first_root).cast("int")
    return held.groupBy("hash_value").agg(F.min_by(F.struct(F.col("root_id").alias("archive_root"), values.full_path().alias("archive_path")), F.struct(first, "root_path", "rel_path")).alias("c")).select("hash_value", "c.*")


def facts_maps(catalog: Catalog, working: DataFrame) -> DataFrame:
    """(id, facts): each source's facts as a map of JSON texts; an object's fact goes before the source's own."""
    facts = catalog.facts.select("entity_type", "entity_id", "key", F.coalesce(values.json_value(), F.lit("null")).alias("json"))
    own = working.select("id").join(facts.where("entity_type = 'source'").withColumnRenamed("entity_id", "id"), "id").select("id", "key", F.struct(F.lit(0).alias("rank"), "json").alias("v"))
    of_object = working.where("object_id is not null").select("id", "object_id").join(facts.where("entity_type = 'object'").withColumnRenamed("entity_id", "object_id"), "object_id").select("id", "key", F.struct(F.lit(1).alias("rank"), "json").alias("v"))
    best = own.unionByName(of_object).groupBy("id", "key").agg(F.max("v").alias("v"))
    return best.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v.json")))).alias("facts"))


def generate(catalog: Catalog, where: Sequence[str], dest: str | None = None, pattern: str = "{filename}", include_archived: bool = False) -> Manifest:
    """A manifest of the sources that ``where`` (at least one filter) selects.

    Excluded sources never come in.  Those with an archive copy are set apart in
    ``archived``, unless ``include_archived``, which also admits files of archive roots.
    ``dest`` must lie in an archive root.
    """
    if not where:
        raise ValueError("a manifest needs a filter")
    root = scopes.root_of(catalog, dest, "archive") if dest else None
    working = scopes.candidates(catalog, where, include_archived=include_archived, include_excluded=True)
    excluded = working.join(scopes.excluded_ids(catalog), "id", "left_semi").agg(F.count("*").alias("excluded"))
    working = working.join(scopes.excluded_ids(catalog), "id", "left_anti")
    hashed = working.join(catalog.objects.select(F.col("id").alias("object_id"), "hash_type", "hash_value"), "object_id", "left").join(archive_copies(catalog), "hash_value", "left")
    path = values.full_path().alias("path")
    archived = hashed.where("archive_path is not null").select("id", path, "archive_path").orderBy("id")
    kept = hashed if include_archived else hashed.where("archive_path is null")
    rows = kept.join(facts_maps(catalog, kept.select("id", "object_id")), "id", "left").select("id", "root_id", path, "size", "object_id", "hash_type", "hash_value", F.coalesce("facts", F.create_map().cast("map<string,string>")).alias("facts"))
    base = "" if not root else dest[len(root["path"]) :].strip("/")
    return Manifest(rows.orderBy("id"), archived.limit(0) if include_archived else archived, excluded, tuple(where), pattern, root["id"] if root else None, base)


@dataclass(frozen=True)
class Plan:
    """What applying a manifest would do (``rows``), and what stands against it."""

    rows: DataFrame
    unresolved: DataFrame
    collisions: DataFrame
    in_destination: DataFrame
    in_other_archives: DataFrame
    excluded: DataFrame

    def blockers(self, allow_cross_archive_duplicates: bool = False) -> list[str]:
        """The names of the checks that fail, in the order in which they are made."""
        checks = [("unresolved", self.unresolved), ("collisions", self.collisions), ("in_destination", self.in_destination), ("excluded", self.excluded)]
        if not allow_cross_archive_duplicates:
            checks.insert(3, ("in_other_archives", self.in_other_archives))
        return [name for name, df in checks if df.limit(1).count()]


def plan_apply(catalog: Catalog, manifest: Manifest, roots: Sequence[str] = ()) -> Plan:
    """The destinations and checks of ``manifest``, for sources of ``roots`` (``id:N``, ``path:P``; all without any)."""
    rows = manifest.sources
    if roots:
        rows = rows.where(F.col("root_id").isin([scopes.resolve_root(catalog, r)["id"] for r in roots]))
    to = expand(manifest.pattern)
    rows = rows.select("id", "root_id", "path", "size", "object_id", "hash_value", to.path.alias("expanded"), to.problem.alias("problem"))
    prefix = manifest.base_dir + "/" if manifest.base_dir else ""
    planned = rows.where("problem is null").select("id", "root_id", "path", "size", "object_id", "hash_value", F.concat(F.lit(prefix), "expanded").alias("dest"))
    copies = rows.where("hash_value is not null").join(archive_copies(catalog, manifest.archive_root_id), "hash_value").select("id", "path", "archive_root", "archive_path")
    here = F.col("archive_root").eqNullSafe(F.lit(manifest.archive_root_id))
    collisions = planned.groupBy("dest").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1").orderBy("dest")
    return Plan(
        planned.orderBy("id"),
        rows.where("problem is not null").select("id", "path", "problem").orderBy("id"),
        collisions,
        copies.where(here).select("id", "path", "archive_path").orderBy("id"),
        copies.where(~here).select("id", "path", "archive_path").orderBy("id"),
        rows.join(scopes.excluded_ids(catalog), "id", "left_semi").select("id", "path").orderBy("id"),
    )


def register(catalog: Catalog, done: DataFrame, archive_root_id: int, moved: bool = False, now: int | None = None) -> Catalog:
    """The catalog after transfers: ``done`` (id, dest, size, mtime).

    A copy is a new source of the archive with the same content.  A moved file takes its
    row along, so its inode stays with one row.
    """
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    columns = catalog.sources.columns
    if moved:
        to = done.select("id", F.col("dest").alias("to"))
        out = catalog.sources.join(to, "id", "left")
        went = F.col("to").isNotNull()
        out = out.withColumn("rel_path", F.coalesce("to", "rel_path")).withColumn("root_id", F.when(went, archive_root_id).otherwise(F.col("root_id"))).withColumn("last_seen_at", F.when(went, at).otherwise(F.col("last_seen_at")))
        return Catalog.of(catalog.roots, out.select(columns), catalog.objects, catalog.facts)
    from pyspark.sql import Window

    top = catalog.sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = done.join(catalog.sources.select("id", "object_id"), "id").withColumn("deal", F.pmod("id", F.lit(1024)))
    before = new.groupBy("deal").count().select("deal", (F.sum("count").over(Window.orderBy("deal")) - F.col("count")).alias("before"))
    new = new.join(F.broadcast(before), "deal").crossJoin(F.broadcast(top)).withColumn("number", F.col("top") + F.col("before") + F.row_number().over(Window.partitionBy("deal").orderBy("id")))
    none = F.lit(None).cast("long")
    rows = new.select(F.col("number").alias("id"), F.lit(archive_root_id).cast("long").alias("root_id"), F.col("dest").alias("rel_path"), none.alias("device"), none.alias("inode"), "size", "mtime", F.lit(0).cast("long").alias("basis_rev"), at.alias("scanned_at"), at.alias("last_seen_at"), F.lit(1).cast("long").alias("present"), "object_id")
    return Catalog.of(catalog.roots, catalog.sources.unionByName(rows), catalog.objects, catalog.facts)
