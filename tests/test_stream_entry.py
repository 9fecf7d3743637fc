"""Batch = stream on the same input; the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from textcurate.functions import text as T
from textcurate.operators import dedup
from textcurate.sources.tables import reviews
from textcurate.streaming import stream as ST


def test_stream_clean_equals_batch(spark):
    s = ST.clean_stream(ST.review_stream(spark, SF001)).select("id", "clean_text")
    got = spark.read.parquet(ST.run_available(s, "t-stream-clean"))
    batch = reviews(spark, SF001).select("id", T.clean_strict("text").alias("clean_text")) \
        .where(T.in_length_range(T.word_count("clean_text")))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["stream_clean", "stream_dedup", "stream_summary"])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, name):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of its own number "), (F.col("id") % 50).cast("string")).alias("text"),
                                  F.lit("d").alias("source"))
    docs.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (part,) = (tmp_path / "part").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    part.rename(tmp_path / "one/documents.parquet")
    many, one = (E.queries()[name](spark, str(tmp_path / d)) for d in ("many", "one"))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    assert many.count() == {"stream_clean": 60, "stream_dedup": 50, "stream_summary": 1}[name]


def test_stream_dedup_keeps_one_row_per_key(spark):
    s = ST.dedup_stream(ST.review_stream(spark, SF001)).select("id", "dup_key")
    got = spark.read.parquet(ST.run_available(s, "t-stream-dedup"))
    v = dedup.verdicts(reviews(spark, SF001), near=False).where("keep_len")
    assert got.count() == v.where(~F.col("is_exact")).count()
    assert got.select("dup_key").distinct().count() == got.count()


def _arrivals(spark, tmp_path, order, rows=30, copies=7):
    """Files of ``rows`` reviews each, in the given order of arrival; every ``copies``-th text repeats."""
    src = tmp_path / "in"
    src.mkdir()
    for at, k in enumerate(order):
        part = str(tmp_path / f"p{k}")
        ids = spark.range(k * rows, (k + 1) * rows)
        text = F.when(F.col("id") % copies == 0, F.lit("this is the same text again")).otherwise(
            F.concat(F.lit("a text of its own number "), (F.col("id") - F.col("id") % 2).cast("string")))
        ids.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("d").alias("source")).coalesce(1).write.parquet(part)
        (name,) = [x for x in os.listdir(part) if x.startswith("part-")]
        os.link(f"{part}/{name}", src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (1_700_000_000 + at, 1_700_000_000 + at))
    return ST.as_reviews(spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(str(src)))


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
def test_first_copy_wins_for_files_in_any_order(spark, tmp_path, order):
    s = ST.first_copies_stream(_arrivals(spark, tmp_path, order), span="40 seconds", watermark="1 day")
    got = ST.first_copies(spark, ST.run_counters(s, "t-first-copies"))
    assert {"id", "pos", "text", "domain", "event_time", "clean_text", "word_count", "dup_key"} == set(got.columns)
    assert sorted(r["id"] for r in got.collect()) == sorted({0} | {min(x for x in (i - i % 2, i - i % 2 + 1) if x % 7) for i in range(120) if i % 7})


def test_first_copies_state_is_bounded(spark, tmp_path):
    """Ten files in order: state holds the open spans, not all keys, and the result is whole."""
    progress = []
    s = ST.first_copies_stream(_arrivals(spark, tmp_path, range(10)), span="30 seconds", watermark="10 seconds")
    got = ST.first_copies(spark, ST.run_counters(s, "t-first-state", progress))
    keys = 300 - 43 + 1
    assert got.count() < keys and got.where("id = 0").count() == 1
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(states) <= 60 < got.count()


def test_stream_summary_equals_batch(spark):
    s = ST.summary_stream(ST.review_stream(spark, SF001))
    got = ST.latest_counters(spark, ST.run_counters(s, "t-stream-summary"), ["domain", "window_start"])
    rv = reviews(spark, SF001).withColumn("wc", T.word_count(T.clean_strict("text")))
    batch = rv.groupBy("domain", F.window(F.timestamp_seconds("pos"), ST.SUMMARY_WINDOW).alias("w")) \
        .agg(F.count("*").alias("processed")).select("domain", F.col("w.start").alias("window_start"),
                                                      "processed")
    j = got.join(batch, ["domain", "window_start"])
    assert j.count() == got.count() == batch.count() > 0
    assert j.where(got.processed != batch.processed).count() == 0


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"id", "original_id", "split", "clean_text"} <= set(df.columns)
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90
