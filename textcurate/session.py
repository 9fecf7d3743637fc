"""Session construction and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings we rely on: AQE re-plans joins and partition counts at runtime, its
# skew-join rule splits hot duplicate keys, and the UI stays off (no server).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of dropped DataFrames are removed from the shared folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "textcurate", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to shared storage; we only read it,
    and it is an error if it is unset: executors would write to their own disks.
    A local session (one machine) without it gets a folder of its own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not is_one_machine(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            d = tempfile.mkdtemp(prefix="textcurate-ckpt-")
            spark.conf.set("spark.checkpoint.dir", d)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder (for sinks and tables)."""
    base = shared_dir(spark).rstrip("/")
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared folder; survives executor loss.

    The rows are persisted while the checkpoint is written, so the plan runs
    once (writing an unpersisted checkpoint recomputes it)."""
    from pyspark import StorageLevel

    shared_dir(df.sparkSession)
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return staged.checkpoint(eager=True)
    finally:
        staged.unpersist()
