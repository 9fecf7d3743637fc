"""No row is lost: null keys, open stream windows, other labels and splits, files of
either layout."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textcurate import session
from textcurate.operators import leakage, leaderboard, metrics, profile, rank, simjoin, splits
from textcurate.sources import envelope, sinks
from textcurate.streaming import stream as ST


def test_null_labels_and_keys_stay(spark):
    rows = [(i if i % 5 else None, ("a", "b", None)[i % 3], i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, n long")
    assert splits.stratified_split(df, "label", "n").count() == 30
    got = splits.stratified_split(df, "label", "n").groupBy("label").pivot("split").count().collect()
    assert all(r["test"] and r["train"] for r in got) and len(got) == 3
    numbered = splits.renumber(df, "id").select("new_id").collect()
    assert sorted(r[0] for r in numbered) == list(range(1, 31))
    assert sorted(r[0] for r in splits.shuffle_rank(df, "id").select("shuffle_rank").collect()) == list(range(1, 31))


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_largest_rank_bucket_is_bounded(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"))
    bucketed = rank.range_bucket(df, "k", bucket_rows=100)
    largest = bucketed.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 160


def test_other_classes_are_counted_or_an_error(spark):
    df = spark.createDataFrame([("m", 3, 3), ("m", 3, 3), ("m", 0, 1)], "model string, y_true long, y_pred long")
    classes = metrics.classes_of(df)
    assert classes == [0, 1, 3]
    cnt = metrics.counters(df, ["model"], classes=classes)
    r = metrics.metric_table(cnt, ["model"], ["accuracy", "macro_f1"], classes).first()
    assert r["accuracy"] == pytest.approx(2 / 3) and r["macro_f1"] == pytest.approx(1 / 3)
    cells = {(x["y_true"], x["y_pred"]): x["n"] for x in metrics.confusion(df, ["model"], classes).collect()}
    assert cells[(3, 3)] == 2 and cells[(0, 1)] == 1 and sum(cells.values()) == 3
    with pytest.raises(Exception, match="label outside the classes: 3"):
        metrics.counters(df, ["model"]).collect()


def test_user_metric(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 1, 0)], "model string, y_true long, y_pred long")
    metrics.METRICS["error_rate"] = lambda ks: 1 - metrics.accuracy()
    try:
        assert metrics.metric_table(metrics.counters(df, ["model"]), ["model"], ["error_rate"]).first()["error_rate"] == 0.5
    finally:
        del metrics.METRICS["error_rate"]


def test_all_pairs_of_five_splits(spark):
    df = spark.createDataFrame([("t", s) for s in ("train", "validation", "test", "extra", "more")], "text string, split string")
    assert leakage.shared_pairs(df, "text").count() == 10
    counts = {r["pair"]: r["shared"] for r in leakage.leak_counts(spark, df).collect()}
    assert len(counts) == 10 and set(counts.values()) == {1} and "train-validation" in counts


def test_model_without_the_metric_is_not_best(spark):
    mm = spark.createDataFrame([("a", None), ("b", 0.5)], "model string, f1 double")
    r = leaderboard.best_by_metric(mm, ["f1"]).first()
    assert (r["best_model"], r["value"]) == ("b", 0.5)


def test_unknown_sources(spark):
    from textcurate.operators import dedup

    df = spark.createDataFrame([("src",), ("other",), (None,)], "source string")
    assert {r[0] for r in df.select(dedup.detector_domain(F.col("source"))).collect()} == {"general"}
    assert {r[0] for r in df.select(profile.research_domain(F.col("source"))).collect()} == {None}


def test_fingerprint_tells_fields_apart(spark):
    a = profile.fingerprint(spark.createDataFrame([("x|y", "z")], "a string, b string"), ["a", "b"]).first()
    b = profile.fingerprint(spark.createDataFrame([("x", "y|z")], "a string, b string"), ["a", "b"]).first()
    c = profile.fingerprint(spark.createDataFrame([("x", None)], "a string, b string"), ["a", "b"]).first()
    assert len({a["content_sum"], b["content_sum"], c["content_sum"]}) == 3


def test_similarity_of_huge_norms(spark):
    df = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "a long, b long")
    assert df.select(simjoin.sim_expr(F.lit(4_000_000_000), F.col("a"), F.col("b"))).first()[0] == 1.0


ENVELOPE = {"domain": "movie", "generated_data": [{"id": 1, "text": "fine film", "sentiment": "positive"},
                                                  {"id": 2, "text": "dull", "sentiment": "negative"}]}


def test_envelopes_of_either_layout(spark, tmp_path):
    (tmp_path / "pretty").mkdir()
    (tmp_path / "lines").mkdir()
    (tmp_path / "pretty" / "a.json").write_text(json.dumps(ENVELOPE, indent=4))
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(ENVELOPE | {"domain": d}) for d in ("x", "y")))
    got = envelope.read_envelopes(spark, str(tmp_path / "pretty")).orderBy("pos").collect()
    assert [(r["domain"], r["id"], r["sentiment"], r["pos"]) for r in got] == [("movie", 1, "positive", 0), ("movie", 2, "negative", 1)]
    assert envelope.read_envelopes(spark, str(tmp_path / "lines")).count() == 4


def test_bad_envelopes_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ENVELOPE) + "\n" + '{"domain": "x", "generated_da')
    with pytest.raises(Exception, match="not an envelope"):
        envelope.read_envelopes(spark, str(tmp_path), multi_line=False).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.json").write_text('{"domain": "x"}')
    with pytest.raises(Exception, match="not an envelope"):
        envelope.read_envelopes(spark, str(tmp_path / "b")).collect()
    (check,) = envelope.envelope_checks(envelope.envelope_records(spark, str(tmp_path / "b"))).collect()
    assert check["has_domain"] and not check["has_generated_data"] and not check["valid"]


def test_mixed_folder_gives_all_good_envelopes(spark, tmp_path):
    """Lines, pretty documents (one, several, a list), blank lines and torn records in one folder."""
    def made(d):
        return ENVELOPE | {"domain": d}

    torn = '{"domain": "torn", "generated_da'
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(made("a")), torn, "", json.dumps(made("b")), "no json", json.dumps(made("c"))]))
    (tmp_path / "pretty.json").write_text(json.dumps(made("d"), indent=4))
    (tmp_path / "several.json").write_text("\n".join(json.dumps(made(d), indent=i) for i, d in enumerate("efg")))
    (tmp_path / "list.json").write_text(json.dumps([made("h"), made("i")], indent=2))
    (tmp_path / "half.json").write_text(json.dumps(made("j"), indent=2)[:90])
    (tmp_path / "part.json").write_text(json.dumps({"domain": "k"}, indent=2))
    (tmp_path / "empty.json").write_text("\n \n")
    records = envelope.envelope_records(spark, str(tmp_path))
    good = envelope.review_rows(records)
    assert {r["domain"]: r["n"] for r in good.groupBy("domain").agg(F.count("*").alias("n")).collect()} == dict.fromkeys("abcdefghi", 2)
    bad = sorted((os.path.basename(r["file"]), r["reason"]) for r in envelope.bad_records(records).collect())
    assert bad == [("half.json", "not JSON of an envelope"), ("lines.json", "not JSON of an envelope"), ("lines.json", "not JSON of an envelope"),
                   ("part.json", "generated_data is missing")]
    assert torn in {r["raw"] for r in envelope.bad_records(records).collect()}


def test_lines_of_a_file_in_many_blocks_stay_in_order(spark, tmp_path):
    """A pretty document read in blocks of a few hundred bytes by several tasks."""
    many = ENVELOPE | {"generated_data": [{"id": i, "text": f"text {i} }} {{ [", "sentiment": "neutral"} for i in range(300)]}
    (tmp_path / "a.json").write_text(json.dumps(many, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = envelope.read_envelopes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["pos"], r["id"]) for r in rows) == [(i, i) for i in range(300)]


def test_trainer_states(spark, tmp_path):
    for run, at, metric in (("20250107_131545", 10, 0.5), ("20250108_090000", 20, 0.75)):
        d = tmp_path / run / f"checkpoint-{at}"
        d.mkdir(parents=True)
        (d / "trainer_state.json").write_text(json.dumps({"global_step": at, "log_history": [
            {"step": at, "loss": 1.5}, {"step": at, "eval_combined_metric": metric, "eval_loss": 1.0}]}, indent=2))
    logs = envelope.read_trainer_states(spark, f"{tmp_path}/*/checkpoint-*/trainer_state.json")
    assert logs.count() == 4
    best = leaderboard.best_checkpoint(logs.withColumnRenamed("entry", "event_id")).first()
    assert (best["run"], best["step"], best["best_metric"]) == ("20250108_090000", 20, 0.75)


def test_metrics_are_per_domain_and_reruns_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, domain string")
    summaries = spark.createDataFrame([("a", 4), ("b", 1), ("c", 9)], "domain string, total_processed long")
    for _ in range(2):
        paths = sinks.write_curated(rows, str(tmp_path), summaries)
    assert spark.read.parquet(paths["data_path"]).count() == 3
    found = {r["domain"]: r["summary"]["total_processed"] for r in spark.read.parquet(paths["metrics_path"]).collect()}
    assert found == {"a": 4, "b": 1, "c": 9}
    one = envelope.dataset_metrics(spark, str(tmp_path), "a_2_20250101_000000").first()
    assert one["domain"] == "a"


def test_stream_summary_keeps_late_rows_and_open_windows(spark, tmp_path):
    """Three files, the newest first, one per trigger: all rows are counted."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src = tmp_path / "in"
    src.mkdir()
    for k, (lo, hi) in enumerate(((130, 200), (60, 130), (0, 60))):
        part = str(tmp_path / f"p{k}")
        docs.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).coalesce(1).write.parquet(part)
        (name,) = [x for x in os.listdir(part) if x.startswith("part-")]
        os.link(f"{part}/{name}", src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(src)).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("domain"),
        F.timestamp_seconds(F.col("doc_id")).alias("event_time"))
    out = ST.latest_counters(spark, ST.run_counters(ST.summary_stream(stream), "t-three-files"), ["domain", "window_start"])
    assert out.agg(F.sum("processed")).first()[0] == 200
    assert out.filter("accepted + length_filtered <> processed").count() == 0


def test_no_folder_of_its_own_on_a_cluster():
    assert session.is_one_machine("local[8]") and session.is_one_machine("local")
    assert not session.is_one_machine("local-cluster[3,2,1024]") and not session.is_one_machine("yarn")


def test_shared_dir_raises_on_a_cluster_without_it():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
