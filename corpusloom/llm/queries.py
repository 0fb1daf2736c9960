"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, line_dedup, mixing, near_dup, quality_model, quality_rules, sharding, toxicity, url_reputation
from ._arrow import small_batches
from .oracles import BAD_WORDS, OP1, OP2, OP3, OP6, OP6_LIMIT, OP8, OP10, RULES, SHOWN

#: Where the public vocabulary files are; a deployment sets its own folder.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad): 1 for pages of a host with a bad word, else what the label of the document shown says, else null."""
    path, host = url_reputation.path_of(F.col("url")), url_reputation.host_of(F.col("url"))
    shown = F.expr(f"try_cast(nullif(regexp_extract(path, r'{SHOWN}', 1), '') AS BIGINT)").cast("string")
    # pages that show no document get keys of their own, so that they meet in no one task
    keyed = pages.select("page_id", "url", path.alias("path"), url_reputation.word_in(host, BAD_WORDS).alias("word")).withColumn("key", F.coalesce(shown, F.concat(F.lit("no "), F.xxhash64("url").cast("string"))))
    judged = F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 0 END")
    known = labels.groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max(judged).alias("label"))
    return keyed.join(known, "key", "left").select("page_id", "url", F.when(F.col("word"), 1).otherwise(F.col("label")).alias("bad"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = page_outcomes(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    judged = url_reputation.judge_urls(outcomes, F.col("bad"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("low", 9).alias("low"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def digest_code(code: bpe.Coded) -> tuple:
    """n_tokens, ids_sha256 and decoded_sha256 of one coded text."""
    decimals, labels = code
    # labels emitted for the ids of a valid text are that text's bytes; any other bytes decode as the library does
    return decimals.count(b",") + 1 if decimals else 0, hashlib.sha256(decimals).hexdigest(), hashlib.sha256(labels.decode("utf-8", "replace").encode()).hexdigest()


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.map_codes(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", digest_code, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), OP6_LIMIT).drop("place")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_reputation": op2_url_reputation,
    "op3_source_mix": op3_source_mix,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_dup": op8_near_dup,
    "op9_quality_grades": op9_quality_grades,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {"op1_line_dedup": OP1, "op2_url_reputation": OP2, "op3_source_mix": OP3, "op6_sharding": OP6, "op8_near_dup": OP8, "op10_quality_rules": OP10}
