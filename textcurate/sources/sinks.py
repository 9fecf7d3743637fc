"""Sinks (SNK-01..04): curated rows, splits, evaluations, dataset ids.

All writes go below the shared folder the cluster names in
``spark.checkpoint.dir`` (see ``textcurate.session``); partitioned layouts let
readers prune by domain, dataset id or split. Curated rows, metrics, evaluations and run
records are staged first and become visible by one manifest row.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_STAMP = "20250101_000000"


def size_label(n: Column) -> Column:
    """SNK-04 size part: >= 1e6 -> '<n//1e6>m', >= 1e3 -> '<n//1e3>k', else n."""
    return (F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("m")))
            .when(n >= 1_000, F.concat(F.floor(n / 1_000).cast("string"), F.lit("k")))
            .otherwise(n.cast("string")))


def dataset_id(domain: Column, n: Column, stamp: str = DEFAULT_STAMP,
               tag: str | None = None) -> Column:
    """SNK-04: '<domain>_<size>_<stamp>[_<tag>]'. The stamp is passed in once
    so data, metrics and splits of one run share one id."""
    parts = [domain, size_label(n), F.lit(stamp)] + ([F.lit(tag)] if tag else [])
    return F.concat_ws("_", *parts)


# ---- staged writes that one manifest row makes visible ------------------------

MANIFEST = "manifest"
MANIFEST_ROW = "key string, attempt string, tables array<string>, stamp string, published_us long"


def stage(tables: dict[str, tuple[DataFrame, list[str]]], base: str) -> str:
    """Writes tables (name -> rows, partition columns) under a new attempt; nobody reads
    them yet."""
    attempt = f"a{uuid.uuid4().hex}"
    for name, (rows, parts) in tables.items():
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        writer.parquet(f"{base}/{name}/attempt={attempt}")
    return attempt


def publish(tables: dict[str, tuple[DataFrame, list[str]]], base: str, key: str, stamp: str) -> dict[str, str]:
    """Writes tables under a new attempt and then one manifest row that makes them all
    visible at once. Of the rows with one ``key`` the newest counts, so a repeated run
    replaces itself, and a run that was killed before its row shows nothing. Returns the path of every table."""
    spark = next(iter(tables.values()))[0].sparkSession
    attempt = stage(tables, base)
    row = [(key, attempt, list(tables), stamp, time.time_ns() // 1000)]
    spark.createDataFrame(row, MANIFEST_ROW).coalesce(1).write.mode("append").parquet(f"{base}/{MANIFEST}")
    return {name: f"{base}/{name}/attempt={attempt}" for name in tables}


def published(spark: SparkSession, base: str, table: str) -> DataFrame:
    """What has been published of a table: the newest attempt of every key. Only these
    folders are read; the manifest has a row per run."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(MANIFEST_ROW).parquet(f"{base}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"nothing is published below {base}") from None
    newest = rows.where(F.array_contains("tables", table)).groupBy("key").agg(F.max_by("attempt", F.struct("published_us", "attempt")).alias("a"))
    paths = [f"{base}/{table}/attempt={r['a']}" for r in newest.collect()]
    if not paths:
        raise FileNotFoundError(f"no table {table!r} is published below {base}")
    return spark.read.option("basePath", f"{base}/{table}").parquet(*paths).drop("attempt")


# ---- the sinks ------------------------------------------------------------------

def metrics_documents(counts: DataFrame, summaries: DataFrame, tag: str | None = None, stamp: str | None = None) -> DataFrame:
    """A metrics document per domain of ``summaries``; ``counts`` (domain, n) are its
    accepted rows. A domain of which no row was accepted has a dataset of size 0."""
    stamp = stamp or DEFAULT_STAMP
    counters = [c for c in summaries.columns if c != "domain"]
    return summaries.join(counts, "domain", "left").select(
        dataset_id(F.col("domain"), F.coalesce("n", F.lit(0)), stamp, tag).alias("dataset_id"), "domain",
        F.lit(stamp).alias("timestamp"), F.struct(*counters).alias("summary"))


def write_metrics(counts: DataFrame, base: str, summaries: DataFrame, tag: str | None = None, stamp: str | None = None) -> str:
    """The metrics documents of a run, without its rows."""
    stamp = stamp or DEFAULT_STAMP
    docs = metrics_documents(counts, summaries, tag, stamp)
    return publish({"metrics": (docs, [])}, base, f"metrics {stamp} {tag}", stamp)["metrics"]


def write_curated(rows: DataFrame, base: str, summaries: DataFrame, tag: str | None = None,
                  stamp: str | None = None, original_file: str | None = None) -> dict:
    """SNK-01: curated rows under (domain, dataset_id) partitions, each with the name of
    the file it came from and the stamp of the run, and one metrics
    document per domain. ``summaries`` has a row per domain with its own counters.

    Rows and documents are published together (see ``publish``): a second run with the same
    stamp and tag replaces the first, a killed one leaves nothing that is read."""
    stamp = stamp or DEFAULT_STAMP
    counts = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    ids = counts.select("domain", dataset_id(F.col("domain"), F.col("n"), stamp, tag).alias("dataset_id"))
    out = rows.join(ids, "domain").withColumns({"original_file": F.lit(original_file or "unknown"), "processing_timestamp": F.lit(stamp)})
    paths = publish({"processed": (out, ["domain", "dataset_id"]), "metrics": (metrics_documents(counts, summaries, tag, stamp), [])},
                    base, f"curated {stamp} {tag}", stamp)
    return {"base": base, "data_path": paths["processed"], "metrics_path": paths["metrics"], "stamp": stamp}


def write_splits(splits: DataFrame, path: str) -> str:
    """SNK-02: one folder per split."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def evaluation_rows(metrics_wide: DataFrame, keys: list[str], dataset: str, stamp: str, confusion: DataFrame | None = None) -> DataFrame:
    """Evaluations in long form: keys, dataset, metric, value, stamp. Confusion counts (keys,
    y_true, y_pred, n) become metrics ``confusion_<true>_<predicted>``."""
    vals = [c for c in metrics_wide.columns if c not in keys]
    long = metrics_wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(keys, vals, "metric", "value")
    if confusion is not None:
        long = long.unionByName(confusion.select(*keys, F.format_string("confusion_%d_%d", "y_true", "y_pred").alias("metric"),
                                                 F.col("n").cast("double").alias("value")))
    return long.withColumns({"dataset": F.lit(dataset), "stamp": F.lit(stamp)})


def write_evaluations(metrics_wide: DataFrame, base: str, keys: list[str], dataset: str, stamp: str | None = None,
                      confusion: DataFrame | None = None) -> str:
    """SNK-03: the evaluations of one dataset and run; run again they replace themselves."""
    stamp = stamp or DEFAULT_STAMP
    rows = evaluation_rows(metrics_wide, keys, dataset, stamp, confusion)
    publish({"evaluations": (rows, [])}, base, f"evaluations {dataset} {stamp}", stamp)
    return base
