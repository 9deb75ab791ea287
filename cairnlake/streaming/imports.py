"""Fact lines as a stream: each micro-batch is imported into the latest snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnlake.catalog import Catalog
from cairnlake.operators.ingest import Imported, import_facts


def snapshot(path: str, number: int) -> str:
    return f"{path}/snapshot-{number:012d}"


def import_stream(spark: SparkSession, inbox: str, catalog_path: str, checkpoint: str, start: str, allow_archived: bool = False, on_batch: Callable[[int, Imported], None] | None = None) -> StreamingQuery:
    """Import new files of JSON lines in ``inbox``; batch n writes ``snapshot-n`` below ``catalog_path``.

    The catalog before batch 0 is at ``start``.  A batch that is run again after a failure
    starts from the same snapshot and replaces its own, so its effect is there once.
    Lateness is decided by each line's revision, not by time: there is no watermark.
    """
    lines = spark.readStream.text(inbox)

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = Catalog.load(session, snapshot(catalog_path, number - 1) if number else start)
        done = import_facts(before, batch.select(F.monotonically_increasing_id().alias("ln"), F.col("value").alias("line")), allow_archived)
        _replace(done.catalog, snapshot(catalog_path, number))
        if on_batch:
            on_batch(number, done)

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace(catalog: Catalog, path: str) -> None:
    catalog.facts.write.mode("overwrite").partitionBy("key").parquet(f"{path}/facts")
    catalog.objects.write.mode("overwrite").parquet(f"{path}/objects")
    catalog.sources.write.mode("overwrite").parquet(f"{path}/sources")
    catalog.roots.write.mode("overwrite").parquet(f"{path}/roots")
