"""Queries over the synthetic tables, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE
from .jaccard_join import jaccard_classes
from .license_scan import license_scan
from .mixing import fair_mix
from .packing import pack
from .parsing import fingerprint_documents
from .prefix_trie import rebuilt_trie
from .quality_rules import quality_rules
from .secret_scan import BASE, secret_scan, span_text
from .sharding import shard_documents
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_files import token_files
from .toxicity import toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_bad"]
    return quality_rules(documents(spark, sf_dir)).select(*cols)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), 4096, end_id=1)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), end_id=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    return secret_scan(documents(spark, sf_dir)).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter(found, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), span_text(found).alias("spans"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spans = F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string")))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.array_join(spans, ",").alias("sentences"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digests=True).withColumnRenamed("kept", "kept_sha256")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), noise=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_sharding": op4_sharding,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling": op13_spelling,
}

