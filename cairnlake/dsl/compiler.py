"""Filters as Catalyst predicates.

All keys that the filters name are pivoted in one pass over the facts, once for
sources and once for objects: two joins however many conditions there are, none if
only built-in keys are named.  A fact is unique per entity and key, so the pivot's
``max`` is exact.  Every condition is true or false, never null: a missing fact makes a
comparison false and its negation true.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.dsl import syntax
from cairnlake.dsl.literals import number_of
from cairnlake.functions import values

EPSILON = 2.220446049250313e-16

# Keys that every source has without facts.
TEXT_KEYS = {"source.ext": "ext", "ext": "ext", "source.root": "root", "source.path": "path", "source.rel_path": "rel"}
NUMBER_KEYS = {"source.size": "size", "size": "size", "source.mtime": "mtime", "mtime": "mtime", "source.device": "device", "source.inode": "inode", "root_id": "root_id"}
ALWAYS_KEYS = {"source.ext", "source.size", "source.mtime", "source.path", "source.root", "source.rel_path", "source.device", "source.inode", "ext", "size", "mtime", "root_id", "basis_rev", "object_id"}
HASH_KEYS = {"content.hash.sha256", "hash", "content_hash", "content_hash.sha256"}


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def text_compare(stored: Column, op: str, literal: str) -> Column:
    """Equality ignores the case of A-Z; order is that of the bytes."""
    if op in ("=", "!="):
        return _compare(values.folded(stored), op, F.lit(literal.translate(str.maketrans(values.UPPER, values.LOWER))))
    return _compare(stored, op, F.lit(literal))


def number_compare(stored: Column, op: str, literal: str) -> Column:
    """Equality within one epsilon; false throughout for a literal that is no number or date."""
    number = number_of(literal)
    if number is None:
        return F.lit(False)
    if op in ("=", "!="):
        near = F.lit(False) if number in (float("inf"), float("-inf")) else F.abs(stored - number) < EPSILON
        return near if op == "=" else ~near
    return _compare(stored, op, F.lit(number))


class Compiled:
    """Filters bound to a catalog: ``enrich`` joins what ``predicate`` needs."""

    def __init__(self, catalog: Catalog, filters: Sequence[str]):
        self.catalog, self.nodes = catalog, [syntax.parse(f) for f in filters]
        used = sorted(set().union(*map(syntax.keys_of, self.nodes))) if self.nodes else []
        self.slots = {k: f"__{{}}_{i}" for i, k in enumerate(k for k in used if k not in TEXT_KEYS and k not in NUMBER_KEYS and k not in ALWAYS_KEYS)}

    def enrich(self, sources: DataFrame) -> DataFrame:
        """``sources`` (with root_path) and the pivoted facts; no row is added or lost."""
        if not self.slots:
            return sources
        facts = self.catalog.facts.where(F.col("key").isin(list(self.slots)))
        value = F.struct("value_text", "value_num", "value_time", F.lit(True).alias("held"))
        for kind, key in (("source", "id"), ("object", "object_id")):
            wide = facts.where(F.col("entity_type") == kind).groupBy(F.col("entity_id").alias(f"__{kind}")).agg(*[F.max(F.when(F.col("key") == k, value)).alias(s.format(kind)) for k, s in self.slots.items()])
            sources = sources.join(wide, F.col(key) == F.col(f"__{kind}"), "left").drop(f"__{kind}")
        return sources

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, map(self._column, self.nodes), F.lit(True))

    def _column(self, node: syntax.Node) -> Column:
        if isinstance(node, syntax.And):
            return reduce(lambda a, b: a & b, map(self._column, node.items))
        if isinstance(node, syntax.Or):
            return reduce(lambda a, b: a | b, map(self._column, node.items))
        if isinstance(node, syntax.Not):
            return ~self._column(node.item)
        if isinstance(node, syntax.In):
            return reduce(lambda a, b: a | b, [self._condition(node.key, "=", v) for v in node.values])
        if isinstance(node, syntax.Exists):
            return self._exists(node.key)
        return self._condition(node.key, node.op, node.value)

    def _held(self, key: str, kind: str) -> Column:
        return F.coalesce(F.col(self.slots[key].format(kind)).getField("held"), F.lit(False))

    def _exists(self, key: str) -> Column:
        if key in ALWAYS_KEYS:
            return F.lit(True)
        stored = self._held(key, "source") | self._held(key, "object")
        return stored | F.col("object_id").isNotNull() if key in HASH_KEYS else stored

    def _condition(self, key: str, op: str, literal: str) -> Column:
        if key in TEXT_KEYS:
            text = {"ext": values.extension(F.col("rel_path")), "root": F.col("root_path"), "path": values.full_path(), "rel": F.col("rel_path")}[TEXT_KEYS[key]]
            return F.coalesce(text_compare(text, op, literal), F.lit(False))
        if key in NUMBER_KEYS:
            return F.coalesce(number_compare(F.col(NUMBER_KEYS[key]).cast("double"), op, literal), F.lit(False))
        if key not in self.slots:
            return F.lit(False)
        return self._fact(self.slots[key].format("source"), op, literal) | self._fact(self.slots[key].format("object"), op, literal)

    @staticmethod
    def _fact(slot: str, op: str, literal: str) -> Column:
        get = F.col(slot).getField
        number = F.coalesce(get("value_num"), get("value_time").cast("double"))
        out = F.when(get("value_text").isNotNull(), text_compare(get("value_text"), op, literal)).when(number.isNotNull(), number_compare(number, op, literal))
        return F.coalesce(out, F.lit(False))


def apply_filters(catalog: Catalog, sources: DataFrame, filters: Sequence[str]) -> DataFrame:
    """The rows of ``sources`` (with root_path) that all filters hold for; all rows without a filter."""
    if not filters:
        return sources
    compiled = Compiled(catalog, filters)
    return compiled.enrich(sources).where(compiled.predicate()).select(sources.columns)
