"""The corpus pipeline: from raw documents to packed training sequences.

Part of the corpus operators (``cairnlake.llm``).  Each stage takes what its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from cairnlake.llm.runtime import materialise, table

BROADCAST_IDS = 500_000


def _named(docs: DataFrame) -> DataFrame:
    """(__id, doc_id, text, ...): rows without an id are named by a hash of their text, above all ids under 2^62."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))))


def _texts(named: DataFrame) -> DataFrame:
    return named.select(F.col("__id").alias("doc_id"), "text")


def _without(named: DataFrame, ids: DataFrame) -> DataFrame:
    """``named`` without the rows whose name is in ``ids``; broadcast where a count shows that they are few."""
    ids = materialise(ids.select(F.col("doc_id").alias("__id")).distinct(), "dropped")
    return named.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``TOXIC_FROM``; empty and null texts too."""
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, "__toxicity").where((F.col("__toxicity") < toxicity.TOXIC_FROM) | (F.coalesce("text", F.lit("")) == "")).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word-shingle similarities of 0.8 or more.

    Rows without an id come after those with one; of a group without ids one row is kept.
    """
    named = _named(docs)
    out = _without(named, jaccard.jaccard_components(_texts(named), 5, 80, 100).where("component_id <> doc_id"))
    copies = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if not docs.where("doc_id is null").limit(1).count():
        return out.select(docs.columns)
    return out.where(~copies).select(docs.columns).unionByName(out.where(copies).dropDuplicates(["text"]).select(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    named = _named(docs)
    return _without(named, decontaminate.contaminated(_texts(named), table(spark, sf_dir, "benchmark"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("n-gram jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("packing", pack)]

#: Learnt scores, tokenizers and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
