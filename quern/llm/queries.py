"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import licenses, mixing, ngram_lm, permutation_index, quality, sampling, simhash, substring, toxicity, weak_rules
from quern.llm.common import table


def op1_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sampling.encode(table(spark, sf_dir, "documents"))
    digest = F.lower(F.hex(F.xxhash64("ids")))
    return made.select("doc_id", "sample", F.size("ids").alias("n_pieces"), digest.alias("ids_digest"), "log_prob", "perturbed", "log_inclusion", "round_trip")


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fourier": op1_quality_fourier,
    "op2_ordinal_toxicity": op2_ordinal_toxicity,
    "op3_weak_rules": op3_weak_rules,
    "op4_content_chunks": op4_content_chunks,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op6_gumbel_segmentations": op6_gumbel_segmentations,
    "op7_permutation_index": op7_permutation_index,
    "op8_fair_queue_mix": op8_fair_queue_mix,
    "op9_simhash_bktree": op9_simhash_bktree,
    "op10_license_dice": op10_license_dice,
}

ORACLE_SQL: dict[str, str] = {
    "op5_stupid_backoff": ngram_lm.LM_SQL,
    "op8_fair_queue_mix": mixing.MIX_SQL,
    "op10_license_dice": licenses.license_sql(),
}
