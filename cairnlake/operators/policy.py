"""Changes of facts: exclusion, deletion, pruning.  Each has a preview and a catalog after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.catalog import Catalog
from cairnlake.functions import values
from cairnlake.operators import scope as scopes

PROTECTED = ("source.", "policy.")


def _targets(catalog: Catalog, where: Sequence[str], scope: str | None) -> DataFrame:
    return scopes.candidates(catalog, where, scope, include_excluded=True)


def exclude_preview(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None) -> DataFrame:
    """(id, path) of the sources that would become excluded, by id."""
    return _targets(catalog, where, scope).join(scopes.excluded_ids(catalog), "id", "left_anti").select("id", values.full_path().alias("path")).orderBy("id")


def exclude_set(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, now: int | None = None) -> Catalog:
    new = _targets(catalog, where, scope).join(scopes.excluded_ids(catalog), "id", "left_anti")
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    rows = new.select(F.lit("source").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(scopes.EXCLUDE_KEY).alias("key"), F.lit("true").alias("value_text"), F.lit(None).alias("value_num"), F.lit(None).alias("value_time"), F.lit(None).alias("value_json"), at.alias("observed_at"), F.col("basis_rev").alias("observed_basis_rev"))
    return catalog.with_(facts=catalog.facts.unionByName(schema.conform(rows, schema.FACTS)))


def exclude_list(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None) -> DataFrame:
    """(id, path) of the excluded sources, by id."""
    return _targets(catalog, where, scope).join(scopes.excluded_ids(catalog), "id", "left_semi").select("id", values.full_path().alias("path")).orderBy("id")


def exclude_clear(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None) -> Catalog:
    ids = exclude_list(catalog, where, scope).select(F.lit("source").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(scopes.EXCLUDE_KEY).alias("key"))
    return catalog.with_(facts=catalog.facts.join(ids, ["entity_type", "entity_id", "key"], "left_anti").select(catalog.facts.columns))


def _doomed(catalog: Catalog, key: str, on: str, where: Sequence[str], scope: str | None) -> DataFrame:
    """The keys of the facts to delete, of all roots and of excluded sources too."""
    if on not in ("source", "object"):
        raise ValueError("facts are deleted on source or object")
    if key.startswith(PROTECTED):
        raise ValueError(f"{key} can't be deleted")
    working = scopes.candidates(catalog, where, scope, include_archived=True, include_excluded=True)
    ids = working.select(F.col("id" if on == "source" else "object_id").alias("entity_id")).where("entity_id is not null").distinct()
    return catalog.facts.where((F.col("entity_type") == on) & (F.col("key") == key)).select("entity_type", "entity_id", "key").join(ids, "entity_id", "left_semi")


def delete_preview(catalog: Catalog, key: str, on: str, where: Sequence[str] = (), scope: str | None = None) -> DataFrame:
    """One row: facts and entities that a deletion would hit."""
    return _doomed(catalog, key, on, where, scope).agg(F.count("*").alias("facts"), F.count_distinct("entity_id").alias("entities"))


def delete_facts(catalog: Catalog, key: str, on: str, where: Sequence[str] = (), scope: str | None = None) -> Catalog:
    gone = _doomed(catalog, key, on, where, scope)
    return catalog.with_(facts=catalog.facts.join(gone, ["entity_type", "entity_id", "key"], "left_anti").select(catalog.facts.columns))


def stale_facts(catalog: Catalog) -> DataFrame:
    """Source facts observed at another revision than the source now has."""
    now = catalog.sources.select(F.col("id").alias("entity_id"), "basis_rev")
    held = catalog.facts.where("entity_type = 'source'").join(now, "entity_id").where("observed_basis_rev <> basis_rev")
    return held.select(catalog.facts.columns)


def prune_preview(catalog: Catalog) -> DataFrame:
    """(key, facts) of the stale facts; exclusions are among them."""
    return stale_facts(catalog).groupBy("key").agg(F.count("*").alias("facts")).orderBy("key")


def prune_stale(catalog: Catalog) -> Catalog:
    gone = stale_facts(catalog).select("entity_type", "entity_id", "key")
    return catalog.with_(facts=catalog.facts.join(gone, ["entity_type", "entity_id", "key"], "left_anti").select(catalog.facts.columns))
