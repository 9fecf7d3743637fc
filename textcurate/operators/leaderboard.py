"""Leaderboards, checkpoint selection and anomaly rules (LDB-*, ANO-*).

Inputs are per-model metric rows (one row per model) or training-log rows.
Ranks over per-model rows are windows over an aggregate whose size is the
number of models; top-N selections over runs use orderBy+limit (a distributed
top-k) and broadcast the N winners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.operators import metrics as M

# Fixed values of the anomaly detector.
ANOMALY_STD = 2.0
MIN_METRIC = 0.1
MIN_MCC = 0.2
HIGH_ACCURACY = 0.8
HIGH_ACCURACY_MCC = 0.4
SUSPICIOUS_ACCURACY = 0.95
MAX_PR_GAP = 0.5
MAJORITY_GAP = 0.05
MAJORITY_MCC = 0.1
MAJORITY_F1 = 0.2
ANOMALY_METRICS = ["accuracy", "precision", "recall", "f1", "mcc"]
KEEP_BEST = 3
TABLE_DECIMALS = 4


def model_metrics(pred: DataFrame) -> DataFrame:
    """Per model: accuracy, macro precision / recall / F1, MCC, balanced
    accuracy and the combined metric (0.5 accuracy + 0.5 macro-F1)."""
    return metrics_of(M.counters(pred, ["model"]))


def metrics_of(cnt: DataFrame, classes: Sequence[int] = M.CLASSES) -> DataFrame:
    return cnt.select(
        "model", M.accuracy().alias("accuracy"), M.macro(M.precision, classes).alias("precision"),
        M.macro(M.recall, classes).alias("recall"), M.macro(M.f1, classes).alias("f1"), M.mcc(classes).alias("mcc"),
        M.balanced_accuracy(classes).alias("balanced_accuracy"),
        (0.5 * M.accuracy() + 0.5 * M.macro(M.f1, classes)).alias("combined"))


def checked_models(pred: DataFrame, classes: Sequence[int] = M.CLASSES) -> tuple[DataFrame, DataFrame]:
    """(metrics of the sound models, report of the failing ones). A model with a label
    outside the classes fails: it is left out and reported (model, n_rows, n_bad,
    message), and the others are ranked as if it were not there."""
    cnt = M.counters(pred, ["model"], classes=classes, count_unknown=True)
    failed = cnt.where("bad > 0").select("model", (F.col("s") + F.col("bad")).alias("n_rows"), F.col("bad").alias("n_bad"),
                                         F.concat(F.lit("label outside the classes: "), F.col("first_bad")).alias("message"))
    return metrics_of(cnt.where("bad = 0"), classes), failed


def leaderboard(mm: DataFrame) -> DataFrame:
    """LDB-01: models ranked by the combined metric (ties by name)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("combined").desc(), F.col("model"))
    return mm.select(F.row_number().over(w).cast("long").alias("rank"), "model", "combined",
                     "accuracy", F.col("f1").alias("macro_f1"))


def research_table(mm: DataFrame, metrics: Sequence[str], sort_metric: str = "combined",
                   decimals: int = TABLE_DECIMALS) -> DataFrame:
    """LDB-02: chosen metrics (missing -> 0) rounded to ``decimals``, ordered by
    the rounded sort metric, descending (ties by model)."""
    cols = [F.round(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), decimals).alias(m)
            for m in metrics]
    t = mm.select("model", *cols)
    key = sort_metric if sort_metric in metrics else metrics[0]
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(key).desc(), F.col("model"))
    return t.withColumn("position", F.row_number().over(w).cast("long"))


def best_by_metric(mm: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """LDB-03: best model per metric (highest value, ties by name) among the models
    that have it."""
    long = mm.unpivot("model", list(metrics), "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.min_by("model", F.struct((-F.col("value")).alias("v"), F.col("model").alias("m")))
        .alias("best_model"), F.max("value").alias("value"))


def best_checkpoint(logs: DataFrame) -> DataFrame:
    """LDB-04: the log entry with the highest combined metric; the first
    strictly greater wins, in (run, step, entry) order. No entry -> error."""
    m = logs.where(F.col("eval_combined_metric").isNotNull())
    order = F.struct((-F.col("eval_combined_metric")).alias("v"), F.col("run").alias("r"),
                     F.col("step").alias("s"), F.col("event_id").alias("e"))
    best = m.agg(F.min_by(F.struct("run", "step", "eval_combined_metric"), order).alias("b"),
                 F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 0,
                     F.raise_error(F.lit("no log entry carries a combined metric"))).otherwise(F.col("b"))
    return best.select(checked.alias("b")).select("b.run", "b.step",
                                                  F.col("b.eval_combined_metric").alias("best_metric"))


def run_table(logs: DataFrame) -> DataFrame:
    """One row per run: stamp (first log time) and its metric (max combined
    metric, 0 when the run logged none)."""
    return logs.groupBy("run").agg(
        F.date_format(F.min("ts"), "yyyyMMdd_HHmmss").alias("stamp"),
        F.coalesce(F.max("eval_combined_metric"), F.lit(0.0)).alias("metric_value"))


def archive_plan(runs: DataFrame, keep_best: int = KEEP_BEST,
                 metric: str = "combined_metric") -> DataFrame:
    """LDB-05/06: keep the best N runs, list the rest for the archive with the
    name <stamp>__<metric>_<value:.4f>. A plan table: no files are moved."""
    top = runs.orderBy(F.col("metric_value").desc(), F.col("run")).limit(keep_best) \
              .select("run", F.lit(True).alias("keep"))
    out = runs.join(F.broadcast(top), "run", "left")
    keep = F.coalesce(F.col("keep"), F.lit(False))
    name = F.concat(F.col("stamp"), F.lit(f"__{metric}_"),
                    F.format_string("%.4f", F.col("metric_value")))
    return out.select("run", "stamp", "metric_value", keep.alias("keep"),
                      F.when(~keep, name).alias("archive_name"))


def archive_list(plan: DataFrame) -> DataFrame:
    """LDB-06: the archived runs of an archive table, read from their names
    <stamp>__<metric>_<value>: stamp, metric, metric_value, newest first by stamp."""
    name = F.col("archive_name")
    return plan.where(name.isNotNull()).select(
        "run", F.regexp_extract(name, r"^(.*?)__", 1).alias("stamp"), F.regexp_extract(name, r"__(.*)_[^_]*$", 1).alias("metric"),
        F.regexp_extract(name, r"_([^_]*)$", 1).cast("double").alias("metric_value"))


def loss_gap(logs: DataFrame) -> DataFrame:
    """LDB-07: train and eval loss per (run, step) and their absolute gap."""
    g = logs.groupBy("run", "step").agg(F.avg("loss").alias("train_loss"),
                                        F.avg("eval_loss").alias("eval_loss"))
    g = g.where(F.col("train_loss").isNotNull() | F.col("eval_loss").isNotNull())
    return g.withColumn("gap", F.abs(F.col("train_loss") - F.col("eval_loss")))


def metric_outliers(mm: DataFrame, across: str = "metrics", threshold: float = ANOMALY_STD) -> DataFrame:
    """ANO-05: (model, metric, value, mean, std, z) of the metrics with z > threshold.

    ``across="metrics"`` compares each of a model's five metrics with their own mean and
    population std, as specified; of five values none can have z above 2, so at the default
    threshold it stays silent. ``across="models"`` compares a model's metric with the same
    metric of all other models (leave one out), so one odd model among few stands
    out; it needs two others. A metric that all the others share exactly is an outlier, with a null z, if it differs."""
    long = mm.unpivot("model", ANOMALY_METRICS, "metric", "value").where("value is not null")
    x = F.col("value")
    if across == "metrics":
        w = Window.partitionBy("model")
        t = long.withColumn("mean", F.avg(x).over(w))
        t = t.withColumn("std", F.sqrt(F.avg((x - F.col("mean")) * (x - F.col("mean"))).over(w)))
        t = t.where("std > 0")
    elif across == "models":
        w = Window.partitionBy("metric")  # a row per model
        # centred first: sums of squares of nearly equal values would cancel
        t = long.withColumn("_c", x - F.avg(x).over(w)).withColumn("_n", F.count(F.lit(1)).over(w) - 1)
        t = t.withColumn("_m", (F.sum("_c").over(w) - F.col("_c")) / F.col("_n"))
        others = (F.sum(F.col("_c") * F.col("_c")).over(w) - F.col("_c") * F.col("_c")) / F.col("_n") - F.col("_m") * F.col("_m")
        t = t.withColumn("mean", x - F.col("_c") + F.col("_m")).withColumn("std", F.sqrt(F.when(others > 1e-18, others).otherwise(0.0)))
        t = t.where("_n >= 2")
    else:
        raise ValueError(f"across is 'metrics' or 'models', not {across!r}")
    off = F.abs(x - F.col("mean"))
    t = t.withColumn("z", F.when(F.col("std") > 0, off / F.col("std")))
    return t.where((F.col("z") > threshold) | ((F.col("std") == 0) & (off > 1e-9))).select("model", "metric", "value", "mean", "std", "z")


def anomalies(mm: DataFrame, majority_share: DataFrame, across: str = "metrics") -> DataFrame:
    """ANO-01..08: one row per (model, rule) that fires; rule 5 (``metric_outlier``) by
    ``metric_outliers`` within a model's metrics or across models."""
    j = mm.withColumn("_k", F.lit(0)).join(
        F.broadcast(majority_share.withColumn("_k", F.lit(0))), "_k").drop("_k")
    acc, mcc, f1 = F.col("accuracy"), F.col("mcc"), F.col("f1")
    rules: list[tuple[str, Column]] = [
        ("low_mcc", F.abs(mcc) < MIN_MCC),
        ("accuracy_mcc_mismatch", (acc > HIGH_ACCURACY) & (mcc < HIGH_ACCURACY_MCC)),
        ("low_accuracy", acc < MIN_METRIC),
        ("low_f1", f1 < MIN_METRIC),
        ("suspicious_accuracy", acc > SUSPICIOUS_ACCURACY),
        ("majority_class", (F.abs(acc - F.col("majority_share")) < MAJORITY_GAP)
         & (mcc < MAJORITY_MCC) & (f1 < MAJORITY_F1)),
        ("precision_recall_gap", F.abs(F.col("precision") - F.col("recall")) > MAX_PR_GAP),
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]),
                     lambda x: x.isNotNull())
    outliers = metric_outliers(mm, across).select("model", F.lit("metric_outlier").alias("rule")).distinct()
    return j.select("model", F.explode(fired).alias("rule")).unionByName(outliers)


def majority_share(pred_one_model: DataFrame) -> DataFrame:
    """Largest true-class count over the number of samples (one row)."""
    c = pred_one_model.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("majority_share"))
