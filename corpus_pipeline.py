"""From raw documents to a sharded training mix, in five stages over whole tables.

Each stage gets what its predecessor kept, as a table in the shared folder, and returns rows with
the columns of ``documents``; the last one returns the manifest of the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.llm import decontamination, mixing, near_dedup, quality_classifier, sharding
from tabmeld.llm.queries import QUERIES, SHARDS, prepare, table, text_crc32, text_digest
from tabmeld.session import materialize

# The stages use trained models and alignments, which SQL does not express.
ORACLE_SQL = None


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line field, trained on the labels, rejects."""
    labels = table(prepare(spark), sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~quality_classifier.held_out(F.col("doc_id"))))
    return quality_classifier.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return decontamination.drop_leaks(docs, table(prepare(spark), sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources come near their target weights."""
    prepare(spark)
    return mixing.mix_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    prepare(spark)
    sized = docs.select(
        "doc_id", "source", sharding.text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"),
        text_digest(F.col("text")).alias("digest"),
    )
    return sharding.assign_shards(sized, ["doc_id", "source"], "size", SHARDS, "digest").drop("digest")


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
    ("sharding", cut_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each one keeps is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
