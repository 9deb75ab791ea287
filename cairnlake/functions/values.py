"""Column expressions for paths, typed values and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def full_path(root: str = "root_path", rel: str = "rel_path") -> Column:
    return F.when(F.col(rel) == "", F.col(root)).otherwise(F.concat(F.col(root), F.lit("/"), F.col(rel)))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """After the last dot of the last component; none for a dot file or without a dot."""
    return F.regexp_extract(path, r"(?s)^(?:.*/)?[^/]+\.([^./]*)\z", 1)


def stem(path: Column) -> Column:
    """The file name without its extension and that dot."""
    name = filename(path)
    cut = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)
    return F.when(cut == "", name).otherwise(cut)


def number_text(x: Column) -> Column:
    """A double as text with 15 significant digits: ``3.0``, ``0.1``, ``1.0e+15``."""
    whole = (F.abs(x) < 1e15) & (x == F.floor(x))
    digits = F.format_string("%.14e", x)
    plain = F.regexp_replace(digits.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?[1-9])0+$|(\.0)0*$", "$1$2")
    mantissa = F.regexp_replace(F.regexp_extract(digits, r"^(-?\d\.\d+)e", 1), r"(\.\d*?[1-9])0+$|(\.0)0*$", "$1$2")
    science = F.concat(mantissa, F.regexp_extract(digits, r"(e[+-]\d+)$", 1))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
        .when(whole, F.concat((x + 0.0).cast("decimal(20,0)").cast("string"), F.lit(".0")))
        .when(F.abs(x) == float("inf"), F.when(x > 0, "Inf").otherwise("-Inf"))
        .when((F.abs(x) < 1e15) & (F.abs(x) >= 1e-4), plain)
        .otherwise(science)
    )


def time_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def display(prefix: str = "") -> Column:
    """A fact's value as text: text, number, UTC time or JSON, whichever it has."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("value_text"), number_text(c("value_num")), time_text(c("value_time")), c("value_json"))


def json_value(prefix: str = "") -> Column:
    """A fact's value as JSON text: times as epoch seconds, JSON as it is."""
    c = lambda n: F.col(prefix + n)
    quoted = F.regexp_extract(F.to_json(F.struct(c("value_text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.coalesce(F.when(c("value_text").isNotNull(), quoted), number_text(c("value_num")), c("value_time").cast("string"), c("value_json"))


# The upper bounds and labels of the size report.
SIZE_BUCKETS = [(1 << 10, "< 1 KB"), (1 << 20, "1 KB - 1 MB"), (10 << 20, "1 MB - 10 MB"), (100 << 20, "10 MB - 100 MB"), (1 << 30, "100 MB - 1 GB")]


def size_bucket(size: Column) -> Column:
    out = F.lit("> 1 GB")
    for bound, label in reversed(SIZE_BUCKETS):
        out = F.when(size < bound, label).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def shortened(text: Column, most: int = 38) -> Column:
    """For tables: texts of more than ``most`` characters end in three dots."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def relative_to(path: Column, base: str) -> Column:
    """``.`` for the base itself, the rest of the path below it, else the path."""
    return F.when(path == base, ".").when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, len(base.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def fact_key(key: Column) -> Column:
    """Imported keys live under ``content.``."""
    return F.when(F.startswith(key, F.lit("content.")), key).otherwise(F.concat(F.lit("content."), key))


# EXIF names with a key of their own.
EXIF_NAMES = {"MIMEType": "mime_type", "FileType": "file_type", "ImageWidth": "image.width", "ImageHeight": "image.height", "Duration": "video.duration", "VideoFrameRate": "video.frame_rate", "AudioChannels": "audio.channels"}


def exif_key(name: Column) -> Column:
    """An EXIF tag's fact key: camel case to snake case under ``exif.``, or its own key."""
    out = F.concat(F.lit("exif."), folded(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")))
    for tag, key in EXIF_NAMES.items():
        out = F.when(name == tag, key).otherwise(out)
    return out


def percent(part: Column, of: Column) -> Column:
    """With one decimal; 0 of nothing."""
    return F.when(of == 0, 0.0).otherwise(F.round(100.0 * part / F.when(of == 0, 1).otherwise(of), 1))
