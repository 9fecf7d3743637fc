"""Streaming queries (STR-*): run to completion with availableNow, then read
the sink back, so each equals its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.plans import sqlparts as S
from textcurate.plans.registry import register
from textcurate.session import scratch_path
from textcurate.sources.tables import table
from textcurate.streaming import stream as ST


@register("stream_clean", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
w AS (SELECT id, clean_text, {S.word_count('clean_text')} AS word_count FROM c)
SELECT id, clean_text, word_count FROM w WHERE word_count BETWEEN 5 AND 150""")
def stream_clean(spark, sf):
    """STR-01: continuous strict clean + length filter of the document stream."""
    s = ST.clean_stream(ST.review_stream(spark, sf)).select("id", "clean_text", "word_count")
    return spark.read.parquet(ST.run_available(s, "stream-clean"))


@register("stream_dedup", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
w AS (SELECT clean_text, {S.word_count('clean_text')} AS word_count FROM c)
SELECT DISTINCT {S.dup_key('clean_text')} AS dup_key FROM w WHERE word_count BETWEEN 5 AND 150""")
def stream_dedup(spark, sf):
    """STR-02: continuous exact dedup (watermarked dropDuplicates on the key).
    Which copy a micro-batch keeps is not ordered, so the result is the set of
    surviving keys."""
    s = ST.dedup_stream(ST.review_stream(spark, sf)).select("dup_key")
    return spark.read.parquet(ST.run_available(s, "stream-dedup"))


@register("stream_first_copies", f"""
WITH c AS (SELECT doc_id AS id, source AS domain, {S.clean_strict('text')} AS clean_text FROM documents),
w AS (SELECT id, domain, clean_text, {S.word_count('clean_text')} AS word_count, {S.dup_key('clean_text')} AS dup_key FROM c)
SELECT id, domain, clean_text, word_count FROM w WHERE word_count BETWEEN 5 AND 150
QUALIFY row_number() OVER (PARTITION BY dup_key ORDER BY id) = 1""")
def stream_first_copies(spark, sf):
    """STR-02: the first copy of every text, as whole rows. The documents arrive in files
    of any order, some a trigger, so later copies often come first."""
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, "arrivals")
    docs.repartition(6, F.xxhash64("doc_id")).write.parquet(path)
    arrivals = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(path)
    s = ST.first_copies_stream(ST.as_reviews(arrivals))
    return ST.first_copies(spark, ST.run_counters(s, "stream-first-copies")).select("id", "domain", "clean_text", "word_count")


@register("stream_summary", f"""
WITH c AS (SELECT doc_id, source AS domain, {S.word_count(S.clean_strict('text'))} AS wc FROM documents),
g AS (SELECT domain, (doc_id // 100) * 100 AS window_start, count(*) AS processed,
             count(*) FILTER (WHERE NOT (wc BETWEEN 5 AND 150)) AS length_filtered,
             count(*) FILTER (WHERE wc BETWEEN 5 AND 150) AS accepted FROM c GROUP BY ALL)
SELECT domain, CAST(window_start AS BIGINT) AS window_start, CAST(processed AS BIGINT) AS processed,
       CAST(length_filtered AS BIGINT) AS length_filtered, CAST(accepted AS BIGINT) AS accepted
FROM g""")
def stream_summary(spark, sf):
    """STR-03: per-domain running counters in tumbling windows of the stream (window
    start in seconds), the last state of every window."""
    s = ST.summary_stream(ST.review_stream(spark, sf))
    out = ST.latest_counters(spark, ST.run_counters(s, "stream-summary"), ["domain", "window_start"])
    return out.select("domain", F.unix_seconds("window_start").alias("window_start"),
                      "processed", "length_filtered", "accepted")
