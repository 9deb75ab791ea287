"""Imported JSON values as typed fact values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date forms that an imported string may have, RFC 3339 first.
_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
_PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"
_EXIF = r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"


def seconds_of(text: Column) -> Column:
    """Epoch seconds of a date and time; null for other texts, a date alone among them."""
    clean = F.upper(F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), " ", "T"))
    zoned = F.try_to_timestamp(clean, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return (
        F.when(text.rlike(_RFC3339), F.unix_seconds(zoned))
        .when(text.rlike(_PLAIN), F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
        .when(text.rlike(_EXIF), F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy:MM:dd HH:mm:ssXXX"))))
    )


def typed(value: Column) -> dict[str, Column]:
    """The four value columns of a variant: exactly one is set."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "VOID", "")
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    time = F.when(kind == "STRING", seconds_of(text))
    return {
        "value_text": F.when(time.isNull(), text),
        "value_num": number,
        "value_time": time,
        "value_json": F.when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(value)),
    }
