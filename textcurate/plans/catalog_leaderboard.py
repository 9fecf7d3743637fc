"""Leaderboards, checkpoints and anomaly rules (LDB-*, ANO-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.operators import leaderboard as LB
from textcurate.plans.catalog_metrics import SACC, SBAL, SMCC, cnt_sql, pred_sql, r6, smacro, sf1, sprec, srec
from textcurate.plans.registry import normalise, register
from textcurate.session import scratch_path
from textcurate.sources.tables import predictions, training_logs

_MM_SQL = f"""WITH {pred_sql()},
{cnt_sql('model')},
mm AS (SELECT model, {SACC} AS accuracy, {smacro(sprec)} AS precision, {smacro(srec)} AS recall,
       {smacro(sf1)} AS f1, {SMCC} AS mcc, {SBAL} AS balanced_accuracy,
       0.5 * {SACC} + 0.5 * {smacro(sf1)} AS combined FROM cnt)"""
TABLE_METRICS = ["accuracy", "precision", "recall", "f1", "mcc", "combined"]


def _mm(spark, sf):
    return LB.model_metrics(predictions(spark, sf))


@register("leaderboard", f"""{_MM_SQL}
SELECT row_number() OVER (ORDER BY combined DESC, model) AS rank, model, {r6('combined')} AS combined,
       {r6('accuracy')} AS accuracy, {r6('f1')} AS macro_f1 FROM mm""")
def leaderboard(spark, sf):
    """LDB-01: models ranked by combined metric, with accuracy and macro-F1."""
    return normalise(LB.leaderboard(_mm(spark, sf)))


# One more model for the queries on failing models: on every 13th row it gives a class that
# does not exist.
_ODD_SQL = f"""WITH {pred_sql().replace('pred AS', 'pred0 AS', 1)},
pred AS (SELECT * FROM pred0 UNION ALL SELECT 'odd' AS model, domain, row_id, y_true, CASE WHEN row_id % 13 = 0 THEN 7 ELSE y_pred END, p0, p1, p2
         FROM pred0 WHERE model = 'm5')"""


def _with_odd_model(spark, sf):
    pred = predictions(spark, sf)
    odd = pred.where("model = 'm5'").withColumn("model", F.lit("odd")).withColumn(
        "y_pred", F.when(F.col("row_id") % 13 == 0, 7).otherwise(F.col("y_pred")).cast("long"))
    return pred.unionByName(odd)


@register("leaderboard_of_sound", f"""{_MM_SQL}
SELECT row_number() OVER (ORDER BY combined DESC, model) AS rank, model, {r6('combined')} AS combined,
       {r6('accuracy')} AS accuracy, {r6('f1')} AS macro_f1 FROM mm""")
def leaderboard_of_sound(spark, sf):
    """LDB-01: a model with unknown labels is left out, the others are ranked as without it."""
    return normalise(LB.leaderboard(LB.checked_models(_with_odd_model(spark, sf))[0]))


@register("leaderboard_failures", f"""{_ODD_SQL}
SELECT model, count(*) AS n_rows, count(*) FILTER (y_pred NOT IN (0, 1, 2)) AS n_bad,
       'label outside the classes: ' || min(CAST(y_pred AS VARCHAR)) FILTER (y_pred NOT IN (0, 1, 2)) AS message
FROM pred GROUP BY model HAVING count(*) FILTER (y_pred NOT IN (0, 1, 2)) > 0""")
def leaderboard_failures(spark, sf):
    """LDB-01: the models left out, with what is wrong."""
    return LB.checked_models(_with_odd_model(spark, sf))[1]


@register("research_table", f"""{_MM_SQL},
t AS (SELECT model, {', '.join(f'round(coalesce({m}, 0.0), 4) AS {m}' for m in TABLE_METRICS)} FROM mm)
SELECT *, row_number() OVER (ORDER BY combined DESC, model) AS position FROM t""")
def research_table(spark, sf):
    """LDB-02: result table -- metrics to four decimals, missing -> 0, sorted by
    the rounded combined metric (text rendering is not built)."""
    return normalise(LB.research_table(_mm(spark, sf), TABLE_METRICS))


@register("best_by_metric", f"""{_MM_SQL},
l AS (UNPIVOT mm ON {', '.join(TABLE_METRICS)} INTO NAME metric VALUE value),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rk FROM l)
SELECT metric, model AS best_model, {r6('value')} AS value FROM r WHERE rk = 1""")
def best_by_metric(spark, sf):
    """LDB-03: best model per metric (by the real column, ties by name)."""
    return normalise(LB.best_by_metric(_mm(spark, sf), TABLE_METRICS))


_LOGS_SQL = """logs AS (SELECT user_id AS run, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS step, event_id, ts,
  CASE WHEN event_type = 'view' THEN value / 100 END AS loss,
  CASE WHEN event_type = 'purchase' THEN value / 100 END AS eval_loss,
  CASE WHEN event_type = 'signup' THEN value / 500 END AS eval_combined_metric FROM events)"""


@register("best_checkpoint", f"""WITH {_LOGS_SQL}
SELECT run, step, {r6('eval_combined_metric')} AS best_metric FROM logs WHERE eval_combined_metric IS NOT NULL
ORDER BY eval_combined_metric DESC, run, step, event_id LIMIT 1""")
def best_checkpoint(spark, sf):
    """LDB-04: best checkpoint (run, step) by combined metric; first wins on ties."""
    return normalise(LB.best_checkpoint(training_logs(spark, sf)))


@register("archive_plan", f"""WITH {_LOGS_SQL},
runs AS (SELECT run, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp,
         coalesce(max(eval_combined_metric), 0.0) AS metric_value FROM logs GROUP BY run),
top AS (SELECT run FROM runs ORDER BY metric_value DESC, run LIMIT 3)
SELECT r.run, r.stamp, {r6('r.metric_value')} AS metric_value, t.run IS NOT NULL AS keep,
  CASE WHEN t.run IS NULL THEN r.stamp || '__combined_metric_' || printf('%.4f', r.metric_value) END AS archive_name
FROM runs r LEFT JOIN top t ON t.run = r.run""")
def archive_plan(spark, sf):
    """LDB-05/06: keep the 3 best runs; archive names for the others."""
    return normalise(LB.archive_plan(LB.run_table(training_logs(spark, sf))))


@register("archive_list", f"""WITH {_LOGS_SQL},
runs AS (SELECT run, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp,
         coalesce(max(eval_combined_metric), 0.0) AS metric_value FROM logs GROUP BY run),
top AS (SELECT run FROM runs ORDER BY metric_value DESC, run LIMIT 3)
SELECT run, stamp, 'combined_metric' AS metric, CAST(printf('%.4f', metric_value) AS DOUBLE) AS metric_value
FROM runs WHERE run NOT IN (SELECT run FROM top)""")
def archive_list(spark, sf):
    """LDB-06: the archive table written and its archived runs listed."""
    path = scratch_path(spark, "archive")
    LB.archive_plan(LB.run_table(training_logs(spark, sf))).write.parquet(path)
    return normalise(LB.archive_list(spark.read.parquet(path)))


@register("loss_gap", f"""WITH {_LOGS_SQL},
g AS (SELECT run, step, avg(loss) AS train_loss, avg(eval_loss) AS eval_loss FROM logs GROUP BY run, step)
SELECT run, step, {r6('train_loss')} AS train_loss, {r6('eval_loss')} AS eval_loss,
       {r6('abs(train_loss - eval_loss)')} AS gap
FROM g WHERE train_loss IS NOT NULL OR eval_loss IS NOT NULL""")
def loss_gap(spark, sf):
    """LDB-07: train / eval loss by (run, step) and their gap."""
    return normalise(LB.loss_gap(training_logs(spark, sf)))


_RULES = [
    ("low_mcc", "abs(mcc) < 0.2"),
    ("accuracy_mcc_mismatch", "accuracy > 0.8 AND mcc < 0.4"),
    ("low_accuracy", "accuracy < 0.1"),
    ("low_f1", "f1 < 0.1"),
    ("metric_outlier", "sd > 0 AND greatest(abs(accuracy - mean), abs(precision - mean), abs(recall - mean), "
                       "abs(f1 - mean), abs(mcc - mean)) / sd > 2.0"),
    ("suspicious_accuracy", "accuracy > 0.95"),
    ("majority_class", "abs(accuracy - majority_share) < 0.05 AND mcc < 0.1 AND f1 < 0.2"),
    ("precision_recall_gap", "abs(precision - recall) > 0.5"),
]


@register("anomalies", f"""{_MM_SQL},
ms AS (SELECT CAST(max(n) AS DOUBLE) / sum(n) AS majority_share
       FROM (SELECT y_true, count(*) AS n FROM pred WHERE model = 'm3' GROUP BY y_true)),
j AS (SELECT mm.*, ms.majority_share, (accuracy + precision + recall + f1 + mcc) / 5.0 AS mean FROM mm, ms),
j2 AS (SELECT *, sqrt((pow(accuracy - mean, 2) + pow(precision - mean, 2) + pow(recall - mean, 2)
                      + pow(f1 - mean, 2) + pow(mcc - mean, 2)) / 5.0) AS sd FROM j)
{' UNION ALL '.join(f"SELECT model, '{name}' AS rule FROM j2 WHERE {cond}" for name, cond in _RULES)}""")
def anomalies(spark, sf):
    """ANO-01..08: suspicious-model rules, one row per (model, rule) fired."""
    pred = predictions(spark, sf)
    share = LB.majority_share(pred.where(F.col("model") == "m3"))
    return LB.anomalies(LB.model_metrics(pred), share)


_METRICS = ["accuracy", "precision", "recall", "f1", "mcc"]
_ACROSS_SQL = f"""{_MM_SQL},
l AS (UNPIVOT (SELECT model, {', '.join(_METRICS)} FROM mm) ON {', '.join(_METRICS)} INTO NAME metric VALUE value),
o AS (SELECT a.model, a.metric, a.value, avg(b.value) AS mean, stddev_pop(b.value) AS std
      FROM l a JOIN l b ON b.metric = a.metric AND b.model <> a.model GROUP BY ALL HAVING count(*) >= 2),
out AS (SELECT *, abs(value - mean) / std AS z FROM o WHERE abs(value - mean) > 2 * std)"""


@register("metric_outliers", f"""{_ACROSS_SQL}
SELECT model, metric, {r6('value')} AS value, {r6('mean')} AS mean, {r6('z')} AS z FROM out""")
def metric_outliers(spark, sf):
    """ANO-05 across models: metrics that lie more than two standard deviations of the
    other models' values off their mean."""
    return normalise(LB.metric_outliers(_mm(spark, sf), across="models").drop("std"))


@register("anomalies_across", f"""{_ACROSS_SQL},
ms AS (SELECT CAST(max(n) AS DOUBLE) / sum(n) AS majority_share
       FROM (SELECT y_true, count(*) AS n FROM pred WHERE model = 'm3' GROUP BY y_true)),
j2 AS (SELECT mm.*, ms.majority_share FROM mm, ms)
{' UNION ALL '.join(f"SELECT model, '{name}' AS rule FROM j2 WHERE {cond}" for name, cond in _RULES if name != 'metric_outlier')}
UNION ALL SELECT DISTINCT model, 'metric_outlier' FROM out""")
def anomalies_across(spark, sf):
    """ANO-01..08 with rule 5 across models."""
    pred = predictions(spark, sf)
    share = LB.majority_share(pred.where(F.col("model") == "m3"))
    return LB.anomalies(LB.model_metrics(pred), share, across="models")
