"""Which sources a command looks at: scope, role, presence, exclusion, filters, archive state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.dsl.compiler import apply_filters
from cairnlake.functions import values

EXCLUDE_KEY = "policy.exclude"
ARCHIVE_STATES = (None, "archived", "show", "unarchived", "unhashed")


def excluded_ids(catalog: Catalog) -> DataFrame:
    return catalog.facts.where((F.col("entity_type") == "source") & (F.col("key") == EXCLUDE_KEY)).select(F.col("entity_id").alias("id"))


def in_scope(sources: DataFrame, scope: str | None, compat_like: bool = False) -> DataFrame:
    """Sources strictly below the path ``scope``.

    ``compat_like`` takes ``%`` and ``_`` of the scope as wildcards and ignores the case of
    A-Z, as SQL's LIKE would.
    """
    if scope is None:
        return sources
    path = F.concat(F.col("root_path"), F.lit("/"), F.col("rel_path"))
    below = scope.rstrip("/") + "/"
    if compat_like:
        return sources.where(values.folded(path).like(below.replace("\\", "\\\\").translate(str.maketrans(values.UPPER, values.LOWER)) + "%"))
    return sources.where(F.startswith(path, F.lit(below)))


def candidates(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False, include_excluded: bool = False, roles: Sequence[str] | None = None, compat_like: bool = False) -> DataFrame:
    """Present sources with root_path and role, after every restriction.

    All restrictions are in one plan, so Catalyst orders them; ids need no paging.
    """
    out = catalog.located().where("present = 1")
    roles = roles if roles is not None else None if include_archived else ("source",)
    if roles is not None:
        out = out.where(F.col("role").isin(list(roles)))
    out = in_scope(out, scope, compat_like)
    if not include_excluded:
        out = out.join(excluded_ids(catalog), "id", "left_anti")
    return apply_filters(catalog, out, where)


def resolve_root(catalog: Catalog, spec: str, role: str | None = None) -> dict:
    """The root that ``id:N`` or ``path:P`` names; roots are a short list, read by the driver."""
    kind, _, rest = spec.partition(":")
    if kind == "id" and rest.lstrip("-").isdigit():
        found = catalog.roots.where(F.col("id") == int(rest)).collect()
    elif kind == "path" and rest:
        found = catalog.roots.where(F.col("path") == rest).collect()
    else:
        raise ValueError(f"a root is id:N or path:P, not {spec!r}")
    if not found:
        raise LookupError(f"no root {spec}")
    if role and found[0]["role"] != role:
        raise LookupError(f"root {spec} has the role {found[0]['role']}, not {role}")
    return found[0].asDict()


def root_of(catalog: Catalog, path: str, role: str | None = None) -> dict | None:
    """The root that is or holds ``path``."""
    held = catalog.roots.where((F.col("path") == path) | F.startswith(F.lit(path), F.concat("path", F.lit("/")))).orderBy("id").limit(1).collect()
    if role and (not held or held[0]["role"] != role):
        raise LookupError(f"{path} is not in a root with the role {role}")
    return held[0].asDict() if held else None


def looks_like_path(argument: str) -> bool:
    """Whether a report's argument is a path and no fact key."""
    return argument.startswith(("/", "."))


def archived_objects(catalog: Catalog, archive_root: int | None = None) -> DataFrame:
    """Distinct ``object_id`` present in an archive root, or in the one given."""
    held = catalog.located().where("role = 'archive' and present = 1 and object_id is not null")
    if archive_root is not None:
        held = held.where(F.col("root_id") == archive_root)
    return held.select("object_id").distinct()


def worklist(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False, include_excluded: bool = False) -> DataFrame:
    """(source_id, path, root_id, size, mtime, basis_rev), by id."""
    out = candidates(catalog, where, scope, include_archived, include_excluded)
    return out.select(F.col("id").alias("source_id"), values.full_path().alias("path"), "root_id", "size", "mtime", "basis_rev").orderBy("source_id")


def ls(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, archive_state: str | None = None, include_archived: bool = False, include_excluded: bool = False) -> DataFrame:
    """(id, path, archive_path), by id; ``archive_path`` only where the state is ``show``, a row for each archive copy."""
    if archive_state not in ARCHIVE_STATES:
        raise ValueError(f"archive state {archive_state!r} is none of {ARCHIVE_STATES}")
    out = candidates(catalog, where, scope, include_archived, include_excluded)
    none = F.lit(None).cast("string").alias("archive_path")
    if archive_state == "show":
        copies = catalog.located().where("role = 'archive' and present = 1 and object_id is not null").select("object_id", values.full_path().alias("archive_path"), F.col("root_path").alias("r"), F.col("rel_path").alias("p"))
        shown = out.where("object_id is not null").select("id", values.full_path().alias("path"), "object_id").join(copies, "object_id")
        return shown.orderBy("id", "r", "p").select("id", "path", "archive_path")
    if archive_state == "unhashed":
        out = out.where("object_id is null")
    elif archive_state == "archived":
        out = out.join(archived_objects(catalog), "object_id", "left_semi")
    elif archive_state == "unarchived":
        out = out.where("object_id is not null").join(archived_objects(catalog), "object_id", "left_anti")
    return out.select("id", values.full_path().alias("path"), none).orderBy("id")


def ls_footer(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False) -> DataFrame:
    """One row: sources listed, those that exclusion hides, and those without a content hash."""
    out = candidates(catalog, where, scope, include_archived, True).join(excluded_ids(catalog).distinct().withColumn("hidden", F.lit(True)), "id", "left")
    shown = F.col("hidden").isNull()
    return out.agg(F.count_if(shown).alias("listed"), F.count_if(~shown).alias("excluded"), F.count_if(shown & F.col("object_id").isNull()).alias("unhashed"))


def ls_sources(listed: DataFrame) -> DataFrame:
    """One row: the distinct sources of a listing, which ``show`` may list once for each archive copy."""
    return listed.agg(F.count_distinct("id").alias("sources"))


def excluded_count(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False) -> DataFrame:
    """One row: how many sources the exclusion policy hides."""
    return candidates(catalog, where, scope, include_archived, True).join(excluded_ids(catalog), "id", "left_semi").agg(F.count("*").alias("excluded"))
