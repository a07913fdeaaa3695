"""The registered queries: each applies one operator, with production
parameters, to its whole table and derives the digest columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, language, lines, manifest, naming, packing, quality, secrets, sharding, simhash, substrings, topk
from .common import documents
from .oracle import ORACLE  # noqa: F401


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), distance=2, words_per_shingle=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(n(b[0]) for b in secrets.BASE),
                        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                        secrets.written(F.col("spans")).alias("spans"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(documents(spark, sf_dir)).drop("kept", "other")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.deduplicate(documents(spark, sf_dir)).drop("level", "name")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return clustering.cluster(vectors, k=16, rounds=3, scale=64, dims=64)[0]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    made = manifest.manifest(documents(spark, sf_dir), altered={"text": tampered})
    back = manifest.folded(F.col("again"), F.col("siblings"))
    return made.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("siblings")).alias("proof_sha256"),
                       back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_lines": op10_lines,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}
