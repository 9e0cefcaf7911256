"""One registered query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmeld.llm import (
    decontamination,
    importance_resampling,
    license_scan,
    mixing,
    near_dedup,
    oracles,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_tree,
    token_counts,
    warc,
    whitening,
)
from tabmeld.llm.text import ROWS_PER_BATCH
from tabmeld.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def prepare(spark: SparkSession) -> SparkSession:
    """Engine settings, and Arrow batches small enough that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_digest(text: Column) -> Column:
    """Equal for equal texts; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


@query("op1_sharding", oracles.SHARDING)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"),
        text_digest(F.col("text")).alias("digest"),
    )
    return sharding.assign_shards(docs, ["doc_id"], "size", SHARDS, "digest").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs.where(~held_out), labels.where(~held_out))
    scored = quality_classifier.score_documents(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"), "n_lines"
    )


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_classes(table(spark, sf_dir, "documents"), F.col("doc_id"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), F.col("doc_id")).drop("places")


@query("op5_warc_derivatives", oracles.WARC)
def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.derive(warc.responses(pages, "url", "html", "page_id"))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.find_leaks(docs, items, F.col("doc_id"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), F.col("doc_id"))
    rules = F.filter("found", lambda s: s["rank"] < len(pii.RULES))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.RULES],
        F.sha2(told(rules).cast("binary"), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


def mixed(docs: DataFrame, *carry: str) -> DataFrame:
    """``docs`` by their identity, with their size and what the mix takes of them."""
    sized = docs.select(
        "doc_id",
        "source",
        *carry,
        mixing.word_count(F.col("text")).alias("size"),
        mixing.quality_weight(F.col("text")).alias("quality"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"),
    )
    return mixing.mix_sources(sized, "source", "size", "quality", ["doc_id", "text_md5"])


@query("op8_mixing", oracles.MIXING)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge_documents(docs, quality_classifier.train(docs, labels), F.col("doc_id"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_tree.score_documents(docs, F.col("doc_id"), quality_classifier.held_out(F.col("doc_id"), 10))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), F.col("doc_id"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query("op12_importance_resampling")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target, F.col("doc_id")).drop("n_words")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))
