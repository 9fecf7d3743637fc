"""Published sinks and recorded runs: killed, repeated and failing ones."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textcurate.operators import leaderboard as LB
from textcurate.operators import metrics as M
from textcurate.operators import profile
from textcurate.plans import curate
from textcurate.sources import envelope, sinks


def _rows(spark, n, domain="a"):
    return spark.range(n).select("id", F.lit(domain).alias("domain"))


def _summaries(spark, n):
    return spark.createDataFrame([("a", n)], "domain string, total_processed long")


def test_killed_and_repeated_runs_show_once(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, base, "processed")
    sinks.stage({"processed": (_rows(spark, 9).withColumn("dataset_id", F.lit("x")), ["domain", "dataset_id"])}, base)  # killed
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, base, "processed")
    sinks.write_curated(_rows(spark, 3), base, _summaries(spark, 4), stamp="s1", original_file="f.json")
    sinks.write_curated(_rows(spark, 5), base, _summaries(spark, 6), stamp="s1", original_file="f.json")  # replaces it
    sinks.write_curated(_rows(spark, 2), base, _summaries(spark, 2), stamp="s2")
    got = {(r["dataset_id"], r["original_file"], r["processing_timestamp"]): r["n"] for r in
           sinks.published(spark, base, "processed").groupBy("dataset_id", "original_file", "processing_timestamp").agg(F.count("*").alias("n")).collect()}
    assert got == {("a_5_s1", "f.json", "s1"): 5, ("a_2_s2", "unknown", "s2"): 2}
    assert [r["summary"]["total_processed"] for r in envelope.metrics_history(spark, base, "a").collect()] == [2, 6]
    assert envelope.load_dataset(spark, base, "a_5_s1").count() == 5
    with pytest.raises(FileNotFoundError):
        envelope.load_dataset(spark, base, "a_3_s1")


def test_a_write_that_fails_publishes_nothing(spark, tmp_path):
    bad = _rows(spark, 3).withColumn("x", F.raise_error(F.lit("disk full")).cast("string"))
    good = _rows(spark, 3)
    with pytest.raises(Exception, match="disk full"):
        sinks.publish({"one": (good, []), "two": (bad, [])}, str(tmp_path), "k", "s")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path), "one")


def test_evaluations_with_confusion_cells(spark, tmp_path):
    pred = spark.createDataFrame([("m", 0, 0), ("m", 1, 0), ("n", 2, 2)], "model string, y_true long, y_pred long")
    for _ in range(2):
        sinks.write_evaluations(LB.model_metrics(pred), str(tmp_path), ["model"], "d", confusion=M.confusion(pred, ["model"]))
    rows = sinks.published(spark, str(tmp_path), "evaluations").collect()
    assert len(rows) == 2 * (7 + 9) and {r["stamp"] for r in rows} == {sinks.DEFAULT_STAMP}
    assert {r["metric"]: r["value"] for r in rows if r["model"] == "m"}["confusion_1_0"] == 1


def test_run_counters_equal_the_summary(spark, tmp_path):
    res = curate.run_curation(spark, SF001, sink_dir=str(tmp_path), dataset_tag="t")
    assert res["status"] == "success" and [s["outcome"] for s in res["stages"]] == ["ok"] * 6
    v = curate.dedup.verdicts(curate.documents(spark, SF001))
    assert res["filtering_summary"] == profile.filter_summary(v).first().asDict()
    r = sinks.published(spark, str(tmp_path), "runs").first()
    assert r["status"] == "success" and r["seconds"] > 0 and r["total_processed"] == res["filtering_summary"]["total_processed"]
    assert sinks.published(spark, str(tmp_path), "processed").count() == r["total_accepted"]


def test_an_error_in_duplicate_detection_is_a_status(spark, tmp_path, monkeypatch):
    def broken(*a, **k):
        raise RuntimeError("no executors")
    monkeypatch.setattr(curate.dedup, "verdicts", broken)
    res = curate.run_curation(spark, SF001, sink_dir=str(tmp_path))
    assert res["status"] == "error" and res["message"] == "duplicates: no executors"
    assert [s["outcome"] for s in res["stages"]] == ["ok", "failed", "skipped", "skipped", "skipped", "skipped"]
    r = sinks.published(spark, str(tmp_path), "runs").first()
    assert r["status"] == "error" and r["total_processed"] is None and r["message"] == res["message"]
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path), "processed")


def test_a_missing_input_is_a_status(spark, tmp_path):
    res = curate.run_curation(spark, str(tmp_path / "nowhere"))
    assert res["status"] == "error" and res["stages"][0]["outcome"] == "failed"


def test_a_failing_model_is_reported_and_the_others_ranked(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 1, 0), ("c", 0, 9), ("c", 1, 1), ("d", None, 0), ("d", 1, 5)]
    pred = spark.createDataFrame(rows, "model string, y_true long, y_pred long")
    good, failed = LB.checked_models(pred)
    assert [r["model"] for r in LB.leaderboard(good).orderBy("rank").collect()] == ["a", "b"]
    got = {r["model"]: (r["n_rows"], r["n_bad"], r["message"]) for r in failed.collect()}
    assert got == {"c": (2, 1, "label outside the classes: 9"), "d": (2, 2, "label outside the classes: 5")}


def test_outliers_across_models(spark):
    def row(name, x):
        return (name, x, x, x, x, x)
    mm = spark.createDataFrame([row("a", 0.80), row("b", 0.82), row("c", 0.81), row("odd", 0.30)],
                               "model string, accuracy double, precision double, recall double, f1 double, mcc double")
    assert {r["model"] for r in LB.metric_outliers(mm, "models").collect()} == {"odd"}
    assert LB.metric_outliers(mm, "metrics").count() == 0
    assert LB.metric_outliers(mm.where("model in ('a', 'odd')"), "models").count() == 0  # needs two others
    same = mm.where("model <> 'odd'").withColumns({c: F.lit(0.5) for c in ("accuracy", "precision", "recall", "f1", "mcc")})
    found = LB.metric_outliers(same.unionByName(mm.where("model = 'odd'")), "models").collect()
    assert {r["model"] for r in found} == {"odd"} and {r["z"] for r in found} == {None}
    with pytest.raises(ValueError):
        LB.metric_outliers(mm, "rows")


def test_scores_of_any_shape(spark):
    """No vector, a short one, one with a missing row; other true labels are an error."""
    full = [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6], [0.6, 0.3, 0.1]]
    truth = [0, 1, 2, 1]
    rows = [("full", t, s) for t, s in zip(truth, full)] + [("none", t, None) for t in truth] + [("short", t, s[:2]) for t, s in zip(truth, full)]
    rows += [("gap", t, s if i else None) for i, (t, s) in enumerate(zip(truth, full))]
    df = spark.createDataFrame(rows, "model string, y_true long, scores array<double>").withColumn("y_pred", F.col("y_true"))
    got = {(r["model"], r["label"]): r["auroc"] for r in M.auroc(df, ["model"], scores="scores").collect()}
    assert [got["none", k] for k in range(3)] == [0.0] * 3 and got["short", 2] == 0.0
    assert [got["full", k] for k in range(3)] == [1.0, 1.0, 1.0] == [got["short", 0], got["short", 1], got["full", 2]]
    assert got["gap", 0] == 0.5  # no positive among the rows with scores
    pm = {r["model"]: (r["brier"], r["calibration_error"]) for r in M.prob_metrics(df, ["model"], scores="scores").collect()}
    assert pm["none"] == (0.0, 0.0) and pm["full"][1] == pytest.approx((0.3 + 0.2 + 0.4 + 0.7) / 4)
    bad = df.withColumn("y_true", F.lit(3).cast("long"))
    for fn in (M.auroc, M.prob_metrics):
        with pytest.raises(Exception, match="label outside the classes: 3"):
            fn(bad, ["model"], scores="scores").collect()
    wide = M.auroc(bad, ["model"], classes=[0, 1, 2, 3], scores="scores").where("model = 'full'").collect()
    assert {r["label"]: r["auroc"] for r in wide} == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.0}


def test_empty_summary_cleans_every_text_once(spark):
    """The branches of the verdicts read the short rows that were written, not the documents."""
    import __spark_entry__ as E

    plan = E.queries()["empty_summary"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "RDD" in plan
