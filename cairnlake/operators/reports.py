"""Reports: fact coverage, value distributions, archive coverage, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.functions import values
from cairnlake.operators import scope as scopes

# Built-in facts that a report of all keys shows, and those shown on request.
SHOWN_KEYS = ["source.ext", "source.size", "source.mtime", "source.path"]
HIDDEN_KEYS = ["source.root", "source.rel_path", "source.device", "source.inode"]
DEFAULT_LIMIT = 50


def _attached(catalog: Catalog, working: DataFrame, key: str | None = None) -> DataFrame:
    """Facts of the working set's sources and of their objects, by source id."""
    facts = catalog.facts if key is None else catalog.facts.where(F.col("key") == key)
    own = working.select("id").join(facts.where("entity_type = 'source'").withColumnRenamed("entity_id", "id"), "id")
    of_object = working.where("object_id is not null").select("id", "object_id").join(facts.where("entity_type = 'object'").withColumnRenamed("entity_id", "object_id"), "object_id")
    return own.unionByName(of_object.select(own.columns))


def fact_keys(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False, include_excluded: bool = False, hidden: bool = False) -> DataFrame:
    """(key, cnt, pct, builtin): how many sources have each fact; built-in ones, which all have, first, with the ``hidden`` ones on request."""
    working = scopes.candidates(catalog, where, scope, include_archived, include_excluded)
    total = working.agg(F.count("*").alias("total"))
    found = _attached(catalog, working).select("id", "key").distinct().groupBy("key").agg(F.count("*").alias("cnt")).withColumn("builtin", F.lit(False))
    own = total.select(F.explode(F.array(*map(F.lit, SHOWN_KEYS + HIDDEN_KEYS * hidden))).alias("key"), F.col("total").alias("cnt"), F.lit(True).alias("builtin"))
    out = own.unionByName(found.select("key", "cnt", "builtin")).crossJoin(F.broadcast(total))  # the total is one row
    return out.select("key", "cnt", values.percent(F.col("cnt"), F.col("total")).alias("pct"), "builtin").orderBy(F.desc("builtin"), F.desc("cnt"), "key")


def builtin_value(key: str) -> Column:
    label = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("(null)"))
    ext = F.lower(values.extension(F.col("rel_path")))
    return {
        "source.ext": F.when(ext == "", "(no extension)").otherwise(ext),
        "source.size": values.size_bucket(F.col("size")),
        "source.mtime": F.year(F.timestamp_seconds("mtime")).cast("string"),
        "source.path": values.full_path(),
        "source.root": F.col("root_path"),
        "source.rel_path": F.col("rel_path"),
        "source.device": label("device"),
        "source.inode": label("inode"),
    }[key]


def fact_values(catalog: Catalog, key: str, limit: int = DEFAULT_LIMIT, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = False, include_excluded: bool = False) -> DataFrame:
    """(value, cnt, pct): sources by the value of ``key``, most first, ``limit`` values (0: all).

    A stored key also has the row ``(no value)`` of the sources without it; a source whose
    own value differs from its object's counts for both.
    """
    working = scopes.candidates(catalog, where, scope, include_archived, include_excluded)
    total = working.agg(F.count("*").alias("total"))
    order = [F.desc("cnt"), F.col("value")]
    if key in SHOWN_KEYS + HIDDEN_KEYS:
        counts = working.select(builtin_value(key).alias("value")).groupBy("value").agg(F.count("*").alias("cnt"))
        rest = None
    else:
        held = _attached(catalog, working, key)
        counts = held.select("id", F.coalesce(values.display(), F.lit("(null)")).alias("value")).distinct().groupBy("value").agg(F.count("*").alias("cnt"))
        rest = held.agg(F.count_distinct("id").alias("have")).crossJoin(total).select(F.lit("(no value)").alias("value"), (F.col("total") - F.col("have")).alias("cnt")).where("cnt > 0")
    if limit:
        counts = counts.orderBy(*order).limit(limit)
    out = counts.withColumn("last", F.lit(0))
    if rest is not None:
        out = out.unionByName(rest.withColumn("last", F.lit(1)))
    out = out.crossJoin(F.broadcast(total)).withColumn("pct", values.percent(F.col("cnt"), F.col("total")))
    return out.orderBy("last", *order).select("value", "cnt", "pct")


def _flagged(catalog: Catalog, working: DataFrame, archive_root: int | None) -> DataFrame:
    """The working set with whether each source is excluded, hashed, archived: two joins for all counters."""
    out = working.join(scopes.excluded_ids(catalog).distinct().withColumn("is_excluded", F.lit(True)), "id", "left")
    out = out.join(scopes.archived_objects(catalog, archive_root).withColumn("is_archived", F.lit(True)), "object_id", "left")
    return out.select("root_id", F.col("is_excluded").isNotNull().alias("excluded"), F.col("object_id").isNotNull().alias("hashed"), F.col("is_archived").isNotNull().alias("archived"))


_COUNTERS = ["total", "excluded", "hashed", "archived"]


def _counted(included_only: bool) -> list[Column]:
    held = ~F.col("excluded") if included_only else F.lit(True)
    return [F.count("*").alias("total"), F.count_if(F.col("excluded")).alias("excluded"), F.count_if(F.col("hashed") & held).alias("hashed"), F.count_if(F.col("archived") & held).alias("archived")]


def _derived(df: DataFrame) -> DataFrame:
    included = F.col("total") - F.col("excluded")
    return df.select(
        *[c for c in df.columns if c not in _COUNTERS],
        *_COUNTERS,
        included.alias("included"),
        values.percent(F.col("excluded"), F.col("total")).alias("excluded_pct"),
        values.percent(F.col("hashed"), included).alias("hashed_pct"),
        values.percent(F.col("archived"), F.col("hashed")).alias("archived_pct"),
        (F.col("hashed") - F.col("archived")).alias("unarchived"),
    )


def coverage(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, archive: str | None = None, include_archived: bool = False, include_excluded: bool = True, included_only: bool = False, by_root: bool = False) -> DataFrame:
    """Totals, exclusions, hashes and archive copies: one row, or one for each root, by path.

    ``archive`` (``id:N`` or ``path:P``) asks for copies in that archive.  Hashed and
    archived count excluded sources too, unless ``included_only``.
    """
    root = scopes.resolve_root(catalog, archive, "archive")["id"] if archive else None
    working = scopes.candidates(catalog, where, scope, include_archived, include_excluded)
    flags = _flagged(catalog, working, root)
    if not by_root:
        return _derived(flags.agg(*_counted(included_only)))
    roots = catalog.roots if include_archived else catalog.roots.where("role = 'source'")
    counts = flags.groupBy("root_id").agg(*_counted(included_only))
    out = roots.select(F.col("id").alias("root_id"), "path", "role").join(counts, "root_id", "left").fillna(0, _COUNTERS)
    return _derived(out).orderBy("path")


def coverage_overall(by_root: DataFrame) -> DataFrame:
    """The sum of the roots' rows."""
    return _derived(by_root.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS]))


def duplicates(catalog: Catalog, where: Sequence[str] = (), scope: str | None = None, include_archived: bool = True, include_excluded: bool = False) -> DataFrame:
    """(hash_value, copies, bytes_wasted) of contents that several sources hold, most first."""
    working = scopes.candidates(catalog, where, scope, include_archived, include_excluded)
    many = working.where("object_id is not null").groupBy("object_id").agg(F.count("*").alias("copies"), (F.sum("size") - F.max("size")).alias("bytes_wasted")).where("copies > 1")
    return many.join(catalog.objects.select(F.col("id").alias("object_id"), "hash_value"), "object_id").select("hash_value", "copies", "bytes_wasted").orderBy(F.desc("copies"), "hash_value")


def stale_links(catalog: Catalog) -> DataFrame:
    """(id, path): sources changed since their content hash was observed, whose object may no longer be theirs."""
    stale = catalog.facts.where("entity_type = 'source'").select(F.col("entity_id").alias("id"), "observed_basis_rev")
    changed = catalog.located().where("present = 1 and object_id is not null and basis_rev > 0")
    return changed.join(stale.where("observed_basis_rev is not null").groupBy("id").agg(F.max("observed_basis_rev").alias("seen")), "id", "left").where("seen is null or seen < basis_rev").select("id", values.full_path().alias("path"))


def table_text(df: DataFrame, widths: Sequence[int], limit: int = 1000) -> str:
    """A fixed-width table of a report's first rows, for terminals."""
    cell = lambda v, w: (v if len(v) <= w else v[: w - 3] + "...").ljust(w)
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    return "\n".join(" ".join(cell(v, w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)
