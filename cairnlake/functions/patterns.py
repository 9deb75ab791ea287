"""Destination patterns: a template parsed once into one string expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.functions import values

# The facts that may tell when a picture was taken, best first.
TAKEN_KEYS = ["exif.datetime_original", "content.exif.datetime_original", "content.exif.date_time_original", "content.DateTimeOriginal"]
_DATES = {"year": "yyyy", "month": "MM", "day": "dd", "date": "yyyy-MM-dd"}


@dataclass(frozen=True)
class Expanded:
    """``path``: the destination, null if a variable is unresolved; ``problem``: which one."""

    path: Column
    problem: Column


def expand(pattern: str, path: str = "path", source_id: str = "id", hash_value: str = "hash_value", facts: str = "facts") -> Expanded:
    """The pattern over columns; ``facts`` maps keys to JSON texts.

    Variables: filename, stem, ext, id, hash, hash_short, year, month, day, date, and each
    fact's key with ``_`` for ``.``, which goes before a built-in one of that name.
    """
    p, known = F.col(path), F.col(facts)
    taken = F.coalesce(*[F.try_element_at(known, F.lit(k)) for k in TAKEN_KEYS])
    seconds = taken.try_cast("bigint")
    built_in = {
        "filename": F.when(values.filename(p) != "", values.filename(p)),
        "stem": F.when(values.stem(p) != "", values.stem(p)),
        "ext": F.when(values.extension(p) != "", values.extension(p)),
        "id": F.col(source_id).cast("string"),
        "hash": F.col(hash_value),
        "hash_short": F.substring(F.col(hash_value), 1, 8),
        **{n: F.date_format(F.timestamp_seconds(seconds), form) for n, form in _DATES.items()},
    }

    def variable(name: str) -> Column:
        named = F.filter(F.map_entries(known), lambda e: F.replace(e["key"], F.lit("."), F.lit("_")) == name)
        raw = F.array_min(F.transform(named, lambda e: F.struct(e["key"], e["value"])))["value"]
        plain = F.when(F.startswith(raw, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).when(~raw.rlike(r"^[\[{]") & (raw != "null"), raw)
        return F.coalesce(plain, built_in[name]) if name in built_in else plain

    pieces = re.split(r"\{([^{}]*)\}", pattern)
    parts = [F.lit(x) if i % 2 == 0 else variable(x) for i, x in enumerate(pieces) if i % 2 or x]
    names = [(F.when(variable(x).isNull(), F.lit("{" + x + "}"))) for x in pieces[1::2]]
    path_out = F.replace(F.replace(F.concat(*parts), F.lit(".."), F.lit("_")), F.lit("\0"), F.lit("_"))
    return Expanded(path_out, F.coalesce(*names, F.lit(None).cast("string")))
