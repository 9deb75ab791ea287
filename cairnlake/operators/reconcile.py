"""Directory listings against the catalog: new, updated, moved, unchanged and missing files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.catalog import Catalog


@dataclass(frozen=True)
class Scan:
    """The catalog after, the action for each file, and the counters."""

    catalog: Catalog
    actions: DataFrame
    counters: DataFrame


def overlapping_roots(catalog: Catalog, path: str) -> DataFrame:
    """Roots that hold ``path`` or lie below it; a root must not overlap another."""
    below = lambda a, b: F.startswith(F.concat(a, F.lit("/")), F.concat(b, F.lit("/")))
    return catalog.roots.where((F.col("path") != path) & (below(F.col("path"), F.lit(path)) | below(F.lit(path), F.col("path"))))


def add_root(catalog: Catalog, path: str, role: str) -> Catalog:
    """The catalog with a root; the known root of that path must have the same role."""
    if role not in ("source", "archive"):
        raise ValueError(f"a root is source or archive, not {role}")
    same = catalog.roots.where(F.col("path") == path).collect()
    if same:
        if same[0]["role"] != role:
            raise ValueError(f"{path} is a root with the role {same[0]['role']}")
        return catalog
    clash = overlapping_roots(catalog, path).select("path").collect()
    if clash:
        raise ValueError(f"{path} overlaps the root {clash[0]['path']}")
    top = catalog.roots.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return catalog.with_(roots=catalog.roots.unionByName(catalog.spark.createDataFrame([(top + 1, path, role)], schema.ROOTS)))


def _matched(catalog: Catalog, listing: DataFrame) -> DataFrame:
    """The listing with the row of the catalog that each file is, by path, else by inode."""
    files = listing.select("root_id", "rel_path", "device", "inode", "size", "mtime")
    old = catalog.sources.select("root_id", "rel_path", F.col("id").alias("old_id"), F.col("device").alias("old_device"), F.col("inode").alias("old_inode"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("basis_rev").alias("old_rev"), F.col("root_id").alias("old_root"))
    by_path = files.join(old, ["root_id", "rel_path"], "left")
    hit, miss = by_path.where("old_id is not null").withColumn("how", F.lit("path")), by_path.where("old_id is null").select(files.columns)
    free = old.join(hit.select("old_id"), "old_id", "left_anti").where("old_device is not null and old_inode is not null").drop("root_id", "rel_path")
    # rows and files of one inode are matched one to one, by id and by path; what is left over is missing or new
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("old_device", "old_inode").orderBy("old_id")))
    known = F.col("device").isNotNull() & F.col("inode").isNotNull()
    linked = miss.where(known).withColumn("k", F.row_number().over(Window.partitionBy("device", "inode").orderBy("root_id", "rel_path")))
    by_inode = linked.join(free.withColumn("device", F.col("old_device")).withColumn("inode", F.col("old_inode")), ["device", "inode", "k"], "left")
    by_inode = by_inode.withColumn("how", F.when(F.col("old_id").isNotNull(), "inode").otherwise("none"))
    new = miss.where(~known).withColumn("how", F.lit("none"))
    return hit.unionByName(by_inode.select(hit.columns)).unionByName(new, allowMissingColumns=True)


def actions(catalog: Catalog, listing: DataFrame) -> DataFrame:
    """(id, root_id, rel_path, action, basis_rev, device, inode, size, mtime): what each listed file is; a new one has no id yet.

    updated: size, time, device or inode differ, and the revision rises; moved: found by its
    inode, the revision rises if the root changed; unchanged; new: revision 0.
    """
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("device").eqNullSafe(F.col("old_device")) & F.col("inode").eqNullSafe(F.col("old_inode"))
    action = F.when(F.col("how") == "path", F.when(same, "unchanged").otherwise("updated")).when(F.col("how") == "inode", "moved").otherwise("new")
    rises = (F.col("action") == "updated") | (F.col("action") == "moved") & (F.col("old_root") != F.col("root_id"))
    out = _matched(catalog, listing).withColumn("action", action)
    return out.select(F.col("old_id").alias("id"), "root_id", "rel_path", "action", F.when(F.col("action") == "new", 0).otherwise(F.col("old_rev") + rises.cast("long")).cast("long").alias("basis_rev"), "device", "inode", "size", "mtime")


def missing(catalog: Catalog, done: DataFrame, root_ids: list[int], prefix: str | None = None) -> DataFrame:
    """Present sources of the scanned roots (below ``prefix``, a path in the root) that no listed file is."""
    there = catalog.sources.where((F.col("present") == 1) & F.col("root_id").isin(root_ids))
    if prefix:
        there = there.where((F.col("rel_path") == prefix) | F.startswith(F.col("rel_path"), F.lit(prefix.rstrip("/") + "/")))
    return there.join(done.select("id").where("id is not null"), "id", "left_anti")


def scan(catalog: Catalog, listing: DataFrame, root_ids: list[int], prefix: str | None = None, now: int | None = None) -> Scan:
    """Reconcile a listing (root_id, rel_path, device, inode, size, mtime) of the roots with the catalog."""
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    done = actions(catalog, listing)
    gone = missing(catalog, done, root_ids, prefix).select("id")
    seen = done.where("id is not null").select("id", *[F.col(c).alias("new_" + c) for c in ("root_id", "rel_path", "basis_rev", "device", "inode", "size", "mtime")])
    old = catalog.sources.join(seen, "id", "left").join(gone.withColumn("gone", F.lit(True)), "id", "left")
    was_seen = F.col("new_root_id").isNotNull()
    pick = lambda c: F.when(was_seen, F.col("new_" + c)).otherwise(F.col(c)).alias(c)
    kept = old.select("id", *[pick(c) for c in ("root_id", "rel_path", "device", "inode", "size", "mtime", "basis_rev")], "scanned_at", F.when(was_seen, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(was_seen, 1).when(F.col("gone"), 0).otherwise(F.col("present")).alias("present"), "object_id")
    top = catalog.sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = done.where("action = 'new'").withColumn("deal", F.pmod(F.xxhash64("root_id", "rel_path"), F.lit(1024)))
    before = new.groupBy("deal").count().select("deal", (F.sum("count").over(Window.orderBy("deal")) - F.col("count")).alias("before"))
    new = new.join(F.broadcast(before), "deal").crossJoin(F.broadcast(top))
    new = new.withColumn("id", F.col("top") + F.col("before") + F.row_number().over(Window.partitionBy("deal").orderBy("root_id", "rel_path")))
    new = new.select("id", "root_id", "rel_path", "device", "inode", "size", "mtime", "basis_rev", at.alias("scanned_at"), at.alias("last_seen_at"), F.lit(1).alias("present"), F.lit(None).cast("long").alias("object_id"))
    counters = done.select("action").unionByName(gone.select(F.lit("missing").alias("action"))).groupBy("action").count()
    sources = schema.conform(kept, schema.SOURCES).unionByName(schema.conform(new, schema.SOURCES))
    return Scan(catalog.with_(sources=sources), done, counters.orderBy("action"))
