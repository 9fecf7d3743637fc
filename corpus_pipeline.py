"""A training-data pipeline over ``documents``.

Each stage works on all that the one before it kept; between stages the documents
are a Parquet table in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textcurate.llm import stages
from textcurate.llm.common import read_table, written

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup_stage),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("source_mixing", stages.mix_sources),
]

# SQL has no SimHash, so the rows are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
