"""Import of fact lines, set at a time, with the results of doing it line by line.

Order matters only where a line links a source to an object: what the source had goes
to the object then.  A window over each source's lines finds the object in force at
each line; the last line of an entity and key wins; facts that a link promotes lose to
anything said of the object itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.catalog import Catalog
from cairnlake.functions import facts as typed_facts
from cairnlake.functions import values

LINE = "source_id bigint, basis_rev bigint, observed_at bigint, facts variant"
HASH_KEY = "content.hash.sha256"
NUMBERED_LINES = 1 << 20


@dataclass(frozen=True)
class Imported:
    """The catalog after, what became of each line, and the counters; all read lines that are parsed once and held."""

    catalog: Catalog
    outcomes: DataFrame
    counters: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give the parsed lines' storage back, once the results have been used."""
        for df in self.held:
            df.unpersist()


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (ln, line) that aren't blank, with their fields; ``facts`` is null if the line is malformed."""
    record = F.from_json("line", LINE)
    out = lines.where(F.trim("line") != "").select("ln", record.alias("r"))
    ok = F.col("r.source_id").isNotNull() & F.col("r.basis_rev").isNotNull() & F.coalesce(F.startswith(F.schema_of_variant("r.facts"), F.lit("OBJECT")), F.lit(False))
    return out.select("ln", F.when(ok, F.col("r.source_id")).alias("source_id"), "r.basis_rev", "r.observed_at", F.when(ok, F.col("r.facts")).alias("facts"))


def judged(catalog: Catalog, lines: DataFrame, allow_archived: bool = False) -> DataFrame:
    """Parsed lines with ``outcome``: malformed, not_found, archived, stale or ok, checked in this order."""
    known = catalog.located().select(F.col("id").alias("source_id"), "role", F.col("basis_rev").alias("now_rev"), "object_id")
    out = parsed(lines).join(known, "source_id", "left")
    outcome = F.when(F.col("facts").isNull(), "malformed").when(F.col("role").isNull(), "not_found")
    if not allow_archived:
        outcome = outcome.when(F.col("role") == "archive", "archived")
    return out.withColumn("outcome", outcome.when(F.col("basis_rev") != F.col("now_rev"), "stale").otherwise("ok"))


def _numbered(df: DataFrame, order: str, start: Column) -> DataFrame:
    """``df`` with ``number``: start + 1, start + 2, ... by ``order``, a distinct number; in ranges, so no task has all rows."""
    df = df.withColumn("range", F.floor(F.col(order) / NUMBERED_LINES))
    before = df.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    return df.join(F.broadcast(before), "range").withColumn("number", start + F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(order))).drop("range", "before")


def import_facts(catalog: Catalog, lines: DataFrame, allow_archived: bool = False, now: int | None = None) -> Imported:
    """Import ``lines`` (ln, line); ``now`` stands in for a missing ``observed_at``.

    The lines are read and parsed once, whatever made them; see ``Imported.release``.
    """
    spark = catalog.spark
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    verdicts = judged(catalog, lines, allow_archived).persist(StorageLevel.MEMORY_AND_DISK)
    ok = verdicts.where("outcome = 'ok'").select("ln", "source_id", "basis_rev", F.coalesce("observed_at", at).alias("observed_at"), "facts", "object_id")
    said = spark.sql("select ln, source_id, basis_rev, observed_at, object_id, key as raw_key, value from {ok}, lateral variant_explode(facts)", ok=ok)
    reserved = F.startswith(F.col("raw_key"), F.lit("source."))
    # one line may name a key twice, with and without its prefix: the full name wins
    pick = Window.partitionBy("ln", "key").orderBy(F.desc(F.startswith(F.col("raw_key"), F.lit("content."))))
    said = said.where(~reserved).withColumn("key", values.fact_key(F.col("raw_key"))).withColumn("pick", F.row_number().over(pick)).where("pick = 1").drop("pick")
    said = said.select("ln", "source_id", "basis_rev", "observed_at", "object_id", "key", *[c.alias(n) for n, c in typed_facts.typed(F.col("value")).items()], (F.schema_of_variant("value") == "STRING").alias("is_text"), F.try_variant_get("value", "$", "string").alias("raw_text"))
    said = said.persist(StorageLevel.MEMORY_AND_DISK)

    # objects: known hashes keep theirs, new ones are numbered by the line that names them first
    hashes = said.where((F.col("key") == HASH_KEY) & F.col("is_text")).select("ln", "source_id", "object_id", F.col("raw_text").alias("hash_value"))
    known = catalog.objects.where("hash_type = 'sha256'").select(F.col("id").alias("known_id"), "hash_value")
    fresh = hashes.groupBy("hash_value").agg(F.min("ln").alias("first_ln")).join(known, "hash_value", "left_anti")
    top = catalog.objects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = _numbered(fresh.crossJoin(F.broadcast(top)), "first_ln", F.col("top")).select("hash_value", F.col("number").alias("fresh_id"))
    links = hashes.join(known, "hash_value", "left").join(fresh, "hash_value", "left").select("ln", "source_id", "object_id", F.coalesce("known_id", "fresh_id").alias("linked"))

    timeline = said.join(links.select("ln", "linked"), "ln", "left")
    so_far = Window.partitionBy("source_id").orderBy("ln").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    timeline = timeline.withColumn("object", F.coalesce(F.last("linked", ignorenulls=True).over(so_far), "object_id"))
    timeline = timeline.withColumn("entity_type", F.when(F.col("object").isNotNull(), "object").otherwise("source")).withColumn("entity_id", F.coalesce("object", "source_id"))
    value = F.struct(*schema.VALUE_COLUMNS, "observed_at", F.when(F.col("entity_type") == "source", F.col("basis_rev")).alias("observed_basis_rev"))
    direct = timeline.groupBy("entity_type", "entity_id", "key").agg(F.max_by(value, "ln").alias("v"), F.max("ln").alias("ln"), F.min("ln").alias("first_ln"))

    # sources that got their first object: when, and which
    gained = links.where("object_id is null").groupBy("source_id").agg(F.min("ln").alias("link_ln"), F.min_by("linked", "ln").alias("object"))
    of_source = direct.where("entity_type = 'source'").select("entity_id", "key", "v", F.lit(1).alias("newer"))
    held = catalog.facts.where("entity_type = 'source'").select("entity_id", "key", F.struct(*schema.VALUE_COLUMNS, "observed_at", "observed_basis_rev").alias("v"), F.lit(0).alias("newer"))
    own = of_source.unionByName(held).groupBy("entity_id", "key").agg(F.max_by("v", "newer").alias("v"))
    moving = own.join(gained.withColumnRenamed("source_id", "entity_id"), "entity_id", "left").withColumn("moves", F.col("object").isNotNull() & F.startswith(F.col("key"), F.lit("content.")))
    staying = moving.where("not moves").select(F.lit("source").alias("entity_type"), "entity_id", "key", "v")
    promoted = moving.where("moves").groupBy(F.col("object").alias("entity_id"), "key").agg(F.min_by("v", "link_ln").alias("v"), F.min("link_ln").alias("link_ln"))

    on_objects = catalog.facts.where("entity_type = 'object'").select("entity_id", "key", F.struct(*schema.VALUE_COLUMNS, "observed_at", "observed_basis_rev").alias("v"), F.lit(1).alias("rank"))
    said_of = direct.where("entity_type = 'object'").select("entity_id", "key", "v", "first_ln")
    ranked = said_of.select("entity_id", "key", "v", F.lit(2).alias("rank")).unionByName(on_objects).unionByName(promoted.select("entity_id", "key", "v", F.lit(0).alias("rank")))
    after = ranked.groupBy("entity_id", "key").agg(F.max_by("v", "rank").alias("v")).select(F.lit("object").alias("entity_type"), "entity_id", "key", "v")
    rows = after.unionByName(staying).select("entity_type", "entity_id", "key", "v.*")
    rows = rows.withColumn("observed_basis_rev", F.when(F.col("entity_type") == "source", F.col("observed_basis_rev")))

    last = links.groupBy("source_id").agg(F.max_by("linked", "ln").alias("linked")).withColumnRenamed("source_id", "id")
    sources = catalog.sources.join(last, "id", "left").withColumn("object_id", F.coalesce("linked", "object_id")).drop("linked")
    new_objects = fresh.select(F.col("fresh_id").alias("id"), F.lit("sha256").alias("hash_type"), "hash_value")
    done = Catalog.of(catalog.roots, sources, catalog.objects.unionByName(new_objects), rows)

    # a promoted fact counts if the object had nothing of that name when it was linked
    held_then = on_objects.select("entity_id", "key").distinct().withColumn("held", F.lit(True))
    moved = promoted.select("entity_id", "key", "link_ln").join(held_then, ["entity_id", "key"], "left").join(said_of.select("entity_id", "key", "first_ln"), ["entity_id", "key"], "left")
    moved = moved.where("held is null and (first_ln is null or first_ln > link_ln)")
    per_line = spark.sql("select ln, count_if(startswith(key, 'source.')) as reserved from {ok}, lateral variant_explode(facts) group by ln", ok=ok).join(said.groupBy("ln").agg(F.count("*").alias("facts")), "ln", "left")
    outcomes = verdicts.select("ln", "source_id", "outcome").join(per_line, "ln", "left").select("ln", "source_id", "outcome", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("reserved", F.lit(0)).alias("reserved"))
    counters = outcomes.agg(F.count("*").alias("lines"), F.coalesce(F.sum("facts"), F.lit(0)).alias("imported"), F.count_if(F.col("outcome") == "stale").alias("stale"), F.coalesce(F.sum("reserved"), F.lit(0)).alias("reserved"), F.count_if(F.col("outcome") == "archived").alias("archived"))
    stored = timeline.where("entity_type = 'object'").agg(F.count("*").alias("direct"))
    counters = counters.crossJoin(fresh.agg(F.count("*").alias("created"))).crossJoin(stored).crossJoin(moved.agg(F.count("*").alias("moved")))
    return Imported(done, outcomes, counters.select("lines", "imported", "stale", "reserved", "archived", "created", (F.col("direct") + F.col("moved")).alias("promoted")), (said, verdicts))
