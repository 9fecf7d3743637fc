"""Metric golden values (FIXTURES.md) and rule edge cases."""

import pytest
from pyspark.sql import functions as F

from textcurate.operators import leaderboard as LB
from textcurate.operators import metrics as M
from textcurate.operators import profile
from textcurate.sources import sinks


def _pred(spark, truth, pred, probs=None):
    probs = probs or [(1 / 3, 1 / 3, 1 / 3)] * len(truth)
    rows = [("m", "d", i, t, p, *pr) for i, (t, p, pr) in enumerate(zip(truth, pred, probs))]
    return spark.createDataFrame(
        rows, "model string, domain string, row_id long, y_true long, y_pred long, p0 double, p1 double, p2 double")


def test_golden_metrics(spark):
    df = _pred(spark, [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0])
    cnt = M.counters(df, ["model"])
    r = M.metric_table(cnt, ["model"], ["accuracy", "macro_f1", "balanced_accuracy", "mcc"]).first()
    assert r["accuracy"] == pytest.approx(4 / 6)
    assert r["macro_f1"] == pytest.approx(0.655556, abs=1e-6)
    assert r["balanced_accuracy"] == pytest.approx(2 / 3)
    assert r["mcc"] == pytest.approx(0.522233, abs=1e-6)
    pc = {x["label"]: x for x in M.per_class(cnt, ["model"]).collect()}
    assert [pc[k]["recall"] for k in range(3)] == pytest.approx([0.5, 1.0, 0.5])
    assert [pc[k]["precision"] for k in range(3)] == pytest.approx([0.5, 2 / 3, 1.0])
    conf = {(x["y_true"], x["y_pred"]): x["n"] for x in M.confusion(df, ["model"]).collect()}
    assert conf[(0, 0)] == 1 and conf[(0, 1)] == 1 and conf[(2, 0)] == 1 and conf[(1, 1)] == 2


def test_single_class_mcc_and_auroc(spark):
    df = _pred(spark, [1, 1, 1], [1, 1, 1])
    cnt = M.counters(df, ["model"])
    assert M.metric_table(cnt, ["model"], ["mcc"]).first()["mcc"] == 0.0
    au = {r["label"]: r["auroc"] for r in M.auroc(df, ["model"]).collect()}
    assert au == {0: 0.5, 1: 0.5, 2: 0.5}


def test_auroc_with_ties(spark):
    scores = [0.2, 0.5, 0.5, 0.9]
    probs = [(1 - s, s, 0.0) for s in scores]
    df = _pred(spark, [0, 0, 1, 1], [0, 1, 1, 1], probs)
    au = {r["label"]: r["auroc"] for r in M.auroc(df, ["model"]).collect()}
    assert au[1] == pytest.approx(0.875)


def test_class_weights_golden(spark):
    w = profile.class_weights(spark, spark.createDataFrame([("healthcare",)], "domain string"), "domain")
    got = [r["weight"] for r in w.orderBy("label_idx").collect()]
    assert got == pytest.approx([1.6216, 0.9730, 0.4054], abs=1e-4)


def test_anomaly_rule5_silent_at_z2(spark):
    mm = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 0.0, 1.0)],
                               "model string, accuracy double, precision double, recall double, f1 double, mcc double")
    share = spark.createDataFrame([(0.5,)], "majority_share double")
    rules = {r["rule"] for r in LB.anomalies(mm, share).collect()}
    assert "metric_outlier" not in rules
    assert "low_accuracy" in rules and "low_f1" in rules


@pytest.mark.parametrize("n,label", [(999, "999"), (1000, "1k"), (46999, "46k"), (1999999, "1m")])
def test_dataset_id_sizes(spark, n, label):
    df = spark.createDataFrame([("x", n)], "d string, n long")
    assert df.select(sinks.size_label(F.col("n"))).first()[0] == label


def test_phase_gate(spark):
    df = _pred(spark, [0, 1, 2, 0], [0, 0, 0, 0])
    g = M.phase_gate(M.counters(df, ["model"]), ["model"]).first()
    assert g["phase2"] is True and g["success"] is False and g["empty_pred_classes"] == 2
