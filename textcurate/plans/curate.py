"""PIP-01: curate end to end. Building the plan runs the jobs that cut lineage and
bound the ranks; what is returned is lazy again.

clean -> length filter -> exact + near duplicates -> renumber -> local id ->
stratified split. ``run_curation`` adds the summary, sinks and a run record; the
verdicts that these read are written once.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textcurate.operators import dedup, profile, splits
from textcurate.session import cut_lineage, scratch_path
from textcurate.sources.tables import UNLABELLED, attach_sentiment, doc_positions, documents


def curated_rows(verdicts: DataFrame, bounds_from: DataFrame | None = None) -> DataFrame:
    """Survivors renumbered: pid = pipeline id 1..N (input order), lid = 0..N-1."""
    kept = verdicts.where(F.col("keep_len") & F.col("dup_type").isNull())
    num = splits.renumber(kept, "pos", out="pid", bounds_from=bounds_from)
    return num.withColumn("lid", F.col("pid") - 1)


def split_curated(cur: DataFrame) -> DataFrame:
    """Stratified 70/15/15 over the sentiment (unlabelled rows form their own
    stratum), seeded on the local id like the reference's shuffle."""
    staged = cur.withColumn("stratum", F.coalesce(F.col("sentiment"), F.lit(UNLABELLED)))
    return splits.stratified_split(staged, "stratum", "lid")


def curate(spark: SparkSession, sf_dir: str, scope: str = "global") -> DataFrame:
    v = dedup.verdicts(documents(spark, sf_dir), scope=scope)
    # labels join the survivors only (narrow rows, after the filters); the
    # survivors are read by the quota count, the rank counts and the rank
    # itself: materialise them once in the shared checkpoint folder
    cur = curated_rows(v, doc_positions(spark, sf_dir))
    cur = cut_lineage(attach_sentiment(cur, spark, sf_dir))
    out = split_curated(cur)
    return out.select(F.col("lid").alias("id"), F.col("pid").alias("original_id"),
                      F.col("pos").alias("doc_id"), "clean_text", "sentiment", "domain", "split")


SUMMARY = ("total_processed", "length_filtered", "duplicates_removed", "exact_duplicates", "near_duplicates", "total_removed",
           "total_accepted")
RUN_ROW = ("run string, started_us long, seconds double, seconds_per_review double, status string, message string, "
           + ", ".join(f"{c} long" for c in SUMMARY) + ", stages array<struct<stage: string, outcome: string, seconds: double>>")


class RecordedStages:
    """A run as stages in order. A stage that raises ends the run: its error is kept, and
    the stages after it are recorded as skipped and return nothing."""

    def __init__(self):
        self.started, self.clock = time.time(), time.perf_counter()
        self.stages: list[dict] = []
        self.message: str | None = None

    def do(self, name: str, work):
        t0 = time.perf_counter()
        out, outcome = None, "skipped"
        if self.message is None:
            try:
                out, outcome = work(), "ok"
            except Exception as e:  # noqa: BLE001 -- an error is an outcome of the run
                outcome, self.message = "failed", f"{name}: {e}"
        self.stages.append({"stage": name, "outcome": outcome, "seconds": time.perf_counter() - t0})
        return out

    @property
    def status(self) -> str:
        return "success" if self.message is None else "error"

    @property
    def seconds(self) -> float:
        return time.perf_counter() - self.clock


def observed_verdicts(rows: DataFrame, scope: str) -> tuple[DataFrame, dict]:
    """The verdicts, written once below the shared folder, and the counters observed while
    they were written (AGG-10): no further pass over them."""
    spark = rows.sparkSession
    seen = Observation("curation")
    path = scratch_path(spark, "verdicts")
    verdicts = dedup.verdicts(rows, scope=scope).observe(seen, *profile.run_counters())
    verdicts.write.parquet(path)
    return spark.read.schema(verdicts.schema).parquet(path), profile.with_totals(seen.get)


def run_curation(spark: SparkSession, sf_dir: str, scope: str = "global",
                 sink_dir: str | None = None, dataset_tag: str | None = None,
                 stamp: str | None = None) -> dict:
    """PIP-01: a full run. Every failure comes back as a status: the outcome of each stage is
    recorded, the first failure stops the rest. With a sink the record is published
    too (table ``runs``), failed runs included."""
    from textcurate.sources import sinks

    stamp = stamp or sinks.DEFAULT_STAMP
    run = RecordedStages()
    rows = run.do("read", lambda: documents(spark, sf_dir))
    v, summary = run.do("duplicates", lambda: observed_verdicts(rows, scope)) or (None, None)
    cur = run.do("number", lambda: cut_lineage(attach_sentiment(curated_rows(v, doc_positions(spark, sf_dir)), spark, sf_dir)))
    out = run.do("split", lambda: split_curated(cur).select(
        F.col("lid").alias("id"), F.col("pid").alias("original_id"),
        F.col("pos").alias("doc_id"), "clean_text", "sentiment", "domain", "split"))
    dist = run.do("distribution", lambda: {r["sentiment"]: r["n"] for r in profile.sentiment_dist(spark, cur).collect()})
    storage = None
    if sink_dir is not None:
        storage = run.do("store", lambda: sinks.write_curated(out, sink_dir, profile.filter_summary(v, "domain"), dataset_tag, stamp,
                                                              original_file="documents.parquet"))
    seconds, n = run.seconds, summary["total_processed"] if summary else 0
    record = {"run": f"{stamp}_{dataset_tag}", "started_us": int(run.started * 1e6), "seconds": seconds,
              "seconds_per_review": seconds / n if n else 0.0, "status": run.status, "message": run.message,
              **{c: summary[c] if summary else None for c in SUMMARY}, "stages": run.stages}
    if sink_dir is not None:
        sinks.publish({"runs": (spark.createDataFrame([record], RUN_ROW), [])}, sink_dir, f"run {record['run']}", stamp)
    if run.message is not None:
        return {"status": "error", "message": run.message, "stages": run.stages}
    return {"status": "success", "filtering_summary": summary, "sentiment_distribution": dist, "storage": storage, "stages": run.stages,
            "performance": {"seconds": seconds, "seconds_per_review": record["seconds_per_review"]}}
