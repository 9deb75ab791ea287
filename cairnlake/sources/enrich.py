"""Facts from outside programs and from their output."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import values
from cairnlake.shipping import ship

OUTPUT = "source_id long, basis_rev long, stdout string, error string"


def kv_facts(output: Column) -> Column:
    """A map from ``key=value`` lines: the first ``=`` parts them, both are trimmed, the last of a key wins."""
    lines = F.filter(F.split(output, "\r?\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "(?s)^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def single_fact(output: Column, key: str) -> Column:
    """A map of one key to the trimmed output; null for no output."""
    text = F.regexp_replace(output, r"^\s+|\s+$", "")
    return F.when(text != "", F.create_map(F.lit(key), text))


def json_facts(output: Column) -> Column:
    """The output as a variant; null unless it is a JSON object."""
    parsed = F.try_parse_json(output)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def merged(old: Column, new: Column) -> Column:
    """Both maps; ``new`` wins."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def exif_facts(tags: Column) -> Column:
    """A map of EXIF tags with the keys that facts have; empty values and the file's own name are left out."""
    held = F.map_filter(tags, lambda k, v: (k != "SourceFile") & v.isNotNull() & (v != ""))
    return F.transform_keys(held, lambda k, _: values.exif_key(k))


def run_command(worklist: DataFrame, command: Sequence[str], timeout: float = 600.0) -> DataFrame:
    """(source_id, basis_rev, stdout, error) of a program run for each row; ``{}`` in an argument is the path.

    A program that fails gives its error and no output; the row stays.
    """
    ship(worklist.sparkSession)
    words = list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source_id, basis_rev, path in batch.itertuples(index=False):
                try:
                    got = subprocess.run([w.replace("{}", path) for w in words], capture_output=True, text=True, timeout=timeout, stdin=subprocess.DEVNULL)
                    rows.append((source_id, basis_rev, got.stdout if got.returncode == 0 else None, None if got.returncode == 0 else got.stderr.strip() or f"exit {got.returncode}"))
                except (OSError, subprocess.SubprocessError) as error:
                    rows.append((source_id, basis_rev, None, str(error)))
            yield pd.DataFrame(rows, columns=["source_id", "basis_rev", "stdout", "error"])

    return worklist.select("source_id", "basis_rev", "path").mapInPandas(run, OUTPUT)


def fact_lines(outputs: DataFrame, mode: str = "kv", key: str | None = None, now: int | None = None) -> DataFrame:
    """(line): what ``run_command`` gave, as lines to import; rows without facts are left out.  Modes: fact, kv, json."""
    if mode == "json":
        facts = F.to_json(json_facts(F.col("stdout")))
    else:
        found = single_fact(F.col("stdout"), key) if mode == "fact" else kv_facts(F.col("stdout"))
        facts = F.when(F.size(found) > 0, F.to_json(found))
    at = F.lit(now) if now is not None else F.unix_timestamp()
    out = outputs.where("stdout is not null").select("source_id", "basis_rev", facts.alias("facts")).where("facts is not null and facts <> '{}'")
    return out.select(F.format_string('{"source_id":%d,"basis_rev":%d,"observed_at":%d,"facts":%s}', "source_id", "basis_rev", at, "facts").alias("line"))


RECORD = "source_id bigint, path string, basis_rev bigint, facts variant"


def records(lines: DataFrame) -> DataFrame:
    """(source_id, path, basis_rev, facts) of work-list lines (line); ``facts``: what an earlier processor found, a map of JSON texts.

    Blank lines and those without a source, path or revision are left out.
    """
    parsed = lines.where(F.trim("line") != "").select(F.from_json("line", RECORD).alias("r")).select("r.*")
    parsed = parsed.where("source_id is not null and path is not null and basis_rev is not null")
    entries = F.from_json(F.to_json("facts"), "map<string,variant>")
    return parsed.select("source_id", "path", "basis_rev", F.transform_values(F.coalesce(entries, F.create_map().cast("map<string,variant>")), lambda _, v: F.to_json(v)).alias("facts"))


def processed(lines: DataFrame, command: Sequence[str], mode: str = "kv", key: str | None = None, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((line), (path, error)): work-list lines through a program, with its facts merged into theirs; the new ones win.

    The lines can go through another processor or be imported.  A program that fails or
    gives no facts leaves no line but an error.  It runs once for each line.
    """
    held = records(lines).select("source_id", "path", "basis_rev", "facts", F.monotonically_increasing_id().alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    got = run_command(held.select(F.col("n").alias("source_id"), "basis_rev", "path"), command)
    got = got.select(F.col("source_id").alias("n"), "stdout", "error").persist(StorageLevel.MEMORY_AND_DISK)
    quoted = lambda m: F.transform_values(m, lambda _, v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    if mode == "json":
        new = F.transform_values(F.from_json(F.to_json(json_facts(F.col("stdout"))), "map<string,variant>"), lambda _, v: F.to_json(v))
    else:
        new = quoted(single_fact(F.col("stdout"), key) if mode == "fact" else kv_facts(F.col("stdout")))
    out = held.join(got, "n").withColumn("new", new)
    good = F.coalesce(F.size("new") > 0, F.lit(False))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(merged(F.col("facts"), F.col("new")))), lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["key"].alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"), e["value"])), ",")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    line = F.concat(F.lit('{"source_id":'), F.col("source_id").cast("string"), F.lit(',"path":'), text("path"), F.lit(',"basis_rev":'), F.col("basis_rev").cast("string"), F.lit(',"observed_at":'), at.cast("string"), F.lit(',"facts":{'), body, F.lit("}}"))
    return out.where(good).orderBy("n").select(line.alias("line")), out.where(~good).select("path", F.coalesce("error", F.lit("no facts")).alias("error"))
