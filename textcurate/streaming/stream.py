"""Structured Streaming versions of the curation steps (STR-01..03).

The same Column expressions as the batch plans (TXT-01, FLT-01, TXT-03) run
on a file-source stream. Runs use ``trigger(availableNow=True)`` into a
parquet table in the shared folder with a checkpoint location next to it, so
a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.session import scratch_path

# Event time of a review in the stream: its input position, in seconds.
# How far rows may arrive out of order, and for how long copies are looked for.
WATERMARK = "30 days"
COPY_SPAN = "1 day"
SUMMARY_WINDOW = "100 seconds"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str,
                      max_files: int | None = None) -> DataFrame:
    """File-source stream over one table in ``sf_dir``, a parquet file or a folder of them.
    A stream takes a folder or a pattern, so the path is a pattern that only the table fits."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path[:-1] + "[t]")


def review_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_reviews(read_table_stream(spark, sf_dir, "documents"))


def as_reviews(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text",
                    F.col("source").alias("domain"),
                    F.timestamp_seconds(F.col("doc_id")).alias("event_time"))


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> str:
    """Process everything available now into a parquet table; returns its path."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", out + "-checkpoint")
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


def run_counters(stream: DataFrame, name: str, progress: list | None = None) -> str:
    """Update mode into a table of running results: every micro-batch writes the
    rows that changed under its own batch number, replacing what an interrupted
    attempt left, so replays change nothing. ``latest_counters`` and ``first_copies``
    read it. ``progress`` receives the progress reports of the run."""
    out = scratch_path(stream.sparkSession, name)

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = (stream.writeStream.outputMode("update").foreachBatch(put)
         .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
    return out


def latest_counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key in a table of running counters."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def clean_stream(reviews: DataFrame) -> DataFrame:
    """STR-01: strict clean + length filter, the batch expressions unchanged."""
    c = reviews.withColumn("clean_text", T.clean_strict("text")) \
               .withColumn("word_count", T.word_count("clean_text"))
    return c.where(T.in_length_range("word_count"))


def dedup_stream(reviews: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """STR-02, one row per key as it comes: exact duplicates dropped within ``watermark``,
    the span of event time in which copies are looked for. State holds a 128-bit hash of
    each key for that long. Which copy a micro-batch keeps is not defined."""
    return _keyed(reviews).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["key_hash"]).drop("key_hash")


def _keyed(reviews: DataFrame) -> DataFrame:
    return clean_stream(reviews).withColumn("dup_key", T.dup_key("clean_text")).withColumn("key_hash", F.md5("dup_key"))


def first_copies_stream(reviews: DataFrame, span: str = COPY_SPAN, watermark: str = WATERMARK) -> DataFrame:
    """STR-02, first copy wins: whole rows, per key and ``span`` of event time the one of
    the smallest position so far; a row is sent again whenever an earlier copy of it turns up.

    State is one row per key and span, and goes when the watermark passes the span's end.
    Copies of one key combine before the shuffle, so a hot key costs a task one row per
    micro-batch and task. For ``run_counters``; ``first_copies`` settles the spans of a key
    against each other. So the result is that of batch for files in any order, as
    long as no row is later than ``watermark``."""
    c = _keyed(reviews)
    rest = [x for x in c.columns if x != "key_hash"]
    return (c.withWatermark("event_time", watermark).groupBy(F.window("event_time", span).alias("w"), "key_hash")
            .agg(F.min_by(F.struct(*rest), F.struct("pos", "id")).alias("r")).select("key_hash", "r.*"))


def first_copies(spark: SparkSession, path: str) -> DataFrame:
    """The first copy of every key in a table that ``first_copies_stream`` filled."""
    rows = spark.read.parquet(path)
    rest = [x for x in rows.columns if x not in ("key_hash", "batch")]
    return rows.groupBy("key_hash").agg(F.min_by(F.struct(*rest), F.struct("pos", "id")).alias("r")).select("r.*")


def summary_stream(reviews: DataFrame) -> DataFrame:
    """STR-03: running counters per domain and tumbling window. Without a watermark
    no row is late and every window is reported, the open one too; state is a few
    counters per domain and window. For ``run_counters`` (update mode)."""
    c = reviews.withColumn("word_count", T.word_count(T.clean_strict("text")))
    keep = T.in_length_range("word_count")
    return (c.groupBy("domain", F.window("event_time", SUMMARY_WINDOW).alias("w"))
            .agg(F.count(F.lit(1)).alias("processed"), F.count_if(~keep).alias("length_filtered"),
                 F.count_if(keep).alias("accepted"))
            .select("domain", F.col("w.start").alias("window_start"), "processed",
                    "length_filtered", "accepted"))
