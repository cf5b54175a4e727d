"""A corpus from documents: quality filter, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns documents; the last one adds size, checksum, shard and slot.
Between stages the documents are written as Parquet and read again. Decisions come back as narrow tables of keys;
they are sent to the documents if they are small, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import row_key, small, table, written
from lexweft.llm.decontaminate import contamination
from lexweft.llm.mixing import mix
from lexweft.llm.neardup import near_duplicates
from lexweft.llm.quality import quality
from lexweft.llm.sharding import shard_documents

SHARDS = 24


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id and text are among ``keys`` (k)."""
    keys = written(keys.select(F.col("k").alias("__lw_k")).distinct(), "rejected")
    keyed = docs.withColumn("__lw_k", row_key("doc_id", "text"))
    return keyed.join(small(keys), "__lw_k", "left_anti").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above their language's threshold."""
    return _without(docs, quality(docs, table(spark, sf_dir, "labels")).filter("NOT keep"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id, and one of rows that repeat it."""
    gone = written(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # rows with equal doc_id and text are copies as well; the usual table has none, and then no text is shuffled
    again = written(kept.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(small(again), "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(small(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: mostly once, less often where a domain is above its target."""
    other = written(mix(docs, table(spark, sf_dir, "labels")).filter("copies <> 1").select(F.col("k").alias("__lw_k"), F.col("copies").alias("__lw_c")).distinct(), "copies")
    counted = docs.withColumn("__lw_k", row_key("doc_id", "text")).join(small(other), "__lw_k", "left")
    repeated = counted.withColumn("__lw_i", F.explode(F.array_repeat(F.lit(0), F.coalesce("__lw_c", F.lit(1)))))
    return repeated.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, law, shard and slot."""
    return shard_documents(docs, SHARDS, payload=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_to_targets),
    ("sharding", shard),
]

#: SQL expresses neither the trained models nor the random shuffle; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
