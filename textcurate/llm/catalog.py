"""One query per operator over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, langid, lbl, licenses, line_dedup, lsh_forest, mixing, quality, suffix_dedup, token_counts, value_tables, walsh_kmeans, winnow
from .common import read_table
from .sql import ORACLE

TOKEN_LIMIT = 4096


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency_rules(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.token_counts(_docs(spark, sf_dir), str(public_tokenizers.path("piece_bpe_32k.model")))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_docs(spark, sf_dir), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_credential_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_digest(_docs(spark, sf_dir))


def op6_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(mixing.measured(_docs(spark, sf_dir)))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ratio", "probability", "weight")], "kept")


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_corpus(_docs(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination_digest(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op12_walsh_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_kmeans.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_tables.compress(read_table(spark, sf_dir, "embeddings"), n_parts=4, size=256, rounds=4)


QUERIES = {f.__name__: f for f in (
    op1_line_frequency, op2_fuzzy_lines, op3_token_counts, op4_lsh_forest, op5_credential_parts, op6_proportional_fitting,
    op7_license_dice, op8_log_bilinear, op9_suffix_dedup, op10_winnowing, op11_language_id, op12_walsh_kmeans, op13_value_dictionaries)}
__all__ = ["ORACLE", "QUERIES"]
