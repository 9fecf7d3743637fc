"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators of a word (space and the ASCII controls 9 to 13).
SEPARATORS = r"[\x20\x09-\x0D]+"
NON_SEPARATOR = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text of a row; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words between separators, as an array; empty for an empty text."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def text_key(text: Column) -> Column:
    """With the document id this names a row: rows that agree in both are
    repeats and share one result."""
    return F.xxhash64(text)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of (doc_id, text_key)."""
    return (left["doc_id"].eqNullSafe(right["doc_id"])) & (left["text_key"] == right["text_key"])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that the cluster shares: computed
    once, read back by column, and there still if executors are lost."""
    from textcurate.session import scratch_path

    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
