"""Sources, sinks and contract checks (SRC-*, SNK-*, VAL-01..03, TXT-12).

Round-trip queries write data derived from the driver tables below the shared
folder (``spark.checkpoint.dir``), read it back through the source under
test, and return what was read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.operators import leaderboard as LB
from textcurate.operators import metrics as M
from textcurate.operators import splits
from textcurate.plans import sqlparts as S
from textcurate.plans.catalog_leaderboard import _LOGS_SQL, _MM_SQL
from textcurate.plans.registry import normalise, register
from textcurate.session import cut_lineage, scratch_path
from textcurate.sources import envelope as E
from textcurate.sources import sinks
from textcurate.sources.tables import doc_positions, documents, predictions, reviews, table, training_logs, whole_reviews

# Fixed value: envelopes hold at most this many reviews (bounded groups).
ENVELOPE_ROWS = 1000
_SIZE_SQL = ("CASE WHEN n >= 1000000 THEN CAST(n // 1000000 AS VARCHAR) || 'm' "
             "WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END")


def _count_label(arr: str, label: str):
    return F.size(F.filter(arr, lambda r: r["sentiment"] == F.lit(label))).cast("long")


def envelopes(spark, sf):
    """Reviews of each domain as envelopes of <= 1000 reviews each (grouped by
    domain and id block, so no group is unbounded)."""
    rv = reviews(spark, sf).withColumn("_blk", F.floor(F.col("pos") / ENVELOPE_ROWS))
    env = rv.groupBy("domain", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("id", "text", "sentiment"))).alias("generated_data"))
    return env.select("domain", "generated_data", F.struct(
        F.size("generated_data").cast("long").alias("total_generated"),
        F.struct(*[_count_label("generated_data", s).alias(s)
                   for s in ["positive", "neutral", "negative"]])
        .alias("sentiment_distribution")).alias("summary"))


def write_envelopes(spark, sf, path):
    """The envelopes as JSON lines."""
    envelopes(spark, sf).write.mode("overwrite").json(path)
    return path


@register("src_envelope", f"""WITH {S.REVIEWS}
SELECT domain, id, text, sentiment,
       row_number() OVER (PARTITION BY domain, pos // {ENVELOPE_ROWS} ORDER BY id) - 1 AS pos FROM reviews""")
def src_envelope(spark, sf):
    """SRC-01: review envelopes (written from the documents) read back one row
    per review with its position in the envelope."""
    path = write_envelopes(spark, sf, scratch_path(spark, "envelopes"))
    return E.read_envelopes(spark, path).drop("file")


_TORN = '{"domain": "%s", "generated_data": [{"id": %s, "text": "torn'


@register("src_mixed_envelopes", f"""WITH {S.REVIEWS},
s AS (SELECT *, coalesce(CAST(regexp_extract(domain, '(\\d+)$', 1) AS BIGINT) % 3, 0) AS k FROM reviews),
b AS (SELECT domain, k, pos // {ENVELOPE_ROWS} AS blk, min(id) AS first FROM s GROUP BY ALL)
SELECT domain, id, text, sentiment, row_number() OVER (PARTITION BY domain, pos // {ENVELOPE_ROWS} ORDER BY id) - 1 AS pos,
       CAST(NULL AS VARCHAR) AS raw FROM s
UNION ALL SELECT NULL, first, NULL, NULL, -1, '{{"domain": "' || domain || '", "generated_data": [{{"id": ' || first || ', "text": "torn'
FROM b WHERE k <> 1""")
def src_mixed_envelopes(spark, sf):
    """SRC-01: one folder with files of lines, of documents that span lines, and of both
    kinds with torn records among them. All good envelopes are read, and one row for each torn record (with the id in it)."""
    path = scratch_path(spark, "mixed-envelopes")
    k = F.coalesce(F.regexp_extract("domain", r"(\d+)$", 1).try_cast("long") % 3, F.lit(0))
    env = cut_lineage(envelopes(spark, sf).withColumn("k", k))
    torn = env.where("k <> 1").select("k", "domain", F.format_string(_TORN, "domain", F.element_at("generated_data", 1)["id"].cast("string")).alias("value"))
    good = F.struct("domain", "generated_data", "summary")
    lines = env.where("k = 0").select("domain", F.to_json(good).alias("value")).unionByName(torn.where("k = 0").drop("k"))
    pretty = env.where("k <> 0").select("domain", F.to_json(good, {"pretty": "true"}).alias("value"))
    lines.repartition("domain").select("value").write.mode("append").text(path)
    pretty.repartition("domain").select("value").write.mode("append").text(path)
    torn.where("k = 2").repartition("domain").select("value").write.mode("append").text(path)
    records = E.envelope_records(spark, path)
    rows = E.review_rows(records).select("domain", "id", "text", "sentiment", "pos", F.lit(None).cast("string").alias("raw"))
    # documents torn after each other in one file are one bad text: it is listed by its records
    raw = F.explode(F.split("raw", r"\n(?=\{)"))
    bad = E.bad_records(records).select(raw.alias("raw")).select(
        F.lit(None).cast("string").alias("domain"), F.regexp_extract("raw", r'"id": (\d+)', 1).cast("long").alias("id"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("sentiment"), F.lit(-1).cast("long").alias("pos"), "raw")
    return rows.unionByName(bad)


@register("val_envelope", """
WITH e AS (SELECT source, doc_id // 1000 AS blk, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 4 AS k, n FROM e)
SELECT CASE WHEN k <> 1 THEN source END AS domain, k <> 1 AS has_domain, k <> 2 AS has_generated_data,
       CAST(CASE WHEN k IN (2, 3) THEN 0 ELSE n END AS BIGINT) AS n_reviews, k = 0 AS valid FROM s""")
def val_envelope(spark, sf):
    """VAL-01: an envelope needs 'domain' and 'generated_data' and at least one
    review. Stored envelopes are checked as they are read; of the sources src<k> those
    with k % 4 = 1, 2, 3 are written without domain, without data, and empty."""
    env = envelopes(spark, sf)
    k = F.regexp_extract("domain", r"(\d+)$", 1).try_cast("long") % 4
    data = F.col("generated_data")
    broken = env.select(F.when(k != 1, F.col("domain")).alias("domain"),
                        F.when(k == 3, F.filter(data, lambda x: F.lit(False))).when(k != 2, data).alias("generated_data"), "summary")
    path = scratch_path(spark, "broken-envelopes")
    broken.write.json(path)
    return E.envelope_checks(E.envelope_records(spark, path)).drop("file")


@register("src_eval_rows", f"""WITH {S.REVIEWS}
SELECT text, CAST(coalesce(CASE lower(trim(sentiment)) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
  WHEN 'positive' THEN 2 END, 1) AS BIGINT) AS label, id FROM reviews""")
def src_eval_rows(spark, sf):
    """SRC-02: evaluation rows -- text and integer label (unknown -> neutral)."""
    return E.eval_rows(reviews(spark, sf).select("id", "text", "sentiment"))


@register("dataset_id", """
WITH c AS (SELECT source AS domain, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), ()))
SELECT coalesce(domain, 'all') AS domain, CAST(n AS BIGINT) AS n,
  coalesce(domain, 'all') || '_' || CASE WHEN n >= 1000000 THEN CAST(n // 1000000 AS VARCHAR) || 'm'
    WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END || '_20250101_000000_synthetic' AS dataset_id
FROM c""")
def dataset_id(spark, sf):
    """SNK-04: dataset id per domain (and overall), fixed stamp and tag."""
    d = table(spark, sf, "documents")
    c = d.groupingSets([["source"], []], "source").agg(F.count(F.lit(1)).cast("long").alias("n"))
    dom = F.coalesce(F.col("source"), F.lit("all"))
    return c.select(dom.alias("domain"), "n",
                    sinks.dataset_id(dom, F.col("n"), sinks.DEFAULT_STAMP, "synthetic").alias("dataset_id"))


def _split_frame(spark, sf):
    """All reviews split 70/15/15, in dataset layout: text, labels, id
    (local 0..N-1 in input order), original_id (document id), split."""
    lab = whole_reviews(spark, sf).select("id", "pos", "text", "sentiment")
    lab = splits.renumber(lab, "pos", out="_lid", bounds_from=doc_positions(spark, sf))
    lab = lab.select((F.col("_lid") - 1).alias("lid"), F.col("id").alias("original_id"),
                     "text", "sentiment")
    sp = splits.stratified_split(lab, "sentiment", "lid")
    return sp.select(F.col("text"), F.col("sentiment").alias("labels"), F.col("lid").alias("id"),
                     "original_id", "split")


_SPLIT_FRAME_SQL = f"""WITH {S.WHOLE},
lab2 AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS lid, id AS original_id, text, sentiment FROM whole),
{S.stratified('lab2', idc='lid')},
frame AS (SELECT text, sentiment AS labels, lid AS id, original_id, split FROM split_rows)"""

# Columns each split must carry, and the consumer formats.
REQUIRED = ["text", "labels", "id", "original_id"]
FORMATS = {"sentiment_classification": {}, "sequence_classification": {"labels": "label"},
           "roberta": {"text": "input_text"}, "bert": {}}


@register("reformat", f"""{_SPLIT_FRAME_SQL}
SELECT split, text AS input_text, labels, id, original_id FROM frame""")
def reformat(spark, sf):
    """TXT-12: project splits for a consumer ('roberta': text -> input_text;
    'sequence_classification': labels -> label); unknown type is an error."""
    return reformat_for(_split_frame(spark, sf), "roberta")


@register("reformat_sequence", f"""{_SPLIT_FRAME_SQL}
SELECT split, text, labels AS label, id, original_id FROM frame""")
def reformat_sequence(spark, sf):
    """TXT-12 for 'sequence_classification': labels -> label."""
    return reformat_for(_split_frame(spark, sf), "sequence_classification")


@register("reformat_as_is", f"""{_SPLIT_FRAME_SQL}
SELECT split, text, labels, id, original_id, fmt FROM frame, (VALUES ('bert'), ('sentiment_classification')) f(fmt)""")
def reformat_as_is(spark, sf):
    """TXT-12 for the two formats that keep all names."""
    frame = cut_lineage(_split_frame(spark, sf))
    one, two = (reformat_for(frame, fmt).withColumn("fmt", F.lit(fmt)) for fmt in ("bert", "sentiment_classification"))
    return one.unionByName(two)


def reformat_for(frame, fmt: str):
    if fmt not in FORMATS:
        raise ValueError(f"no such split format: {fmt!r}; known: {', '.join(sorted(FORMATS))}")
    return frame.withColumnsRenamed(FORMATS[fmt]).select(
        "split", *[FORMATS[fmt].get(c, c) for c in REQUIRED])


@register("val_splits", f"""{_SPLIT_FRAME_SQL},
want(split) AS (VALUES ('train'), ('validation'), ('test')),
have AS (SELECT split, count(*) AS n FROM frame GROUP BY split),
data(dataset, missing) AS (VALUES ('whole', ''), ('broken', 'labels,original_id'))
SELECT d.dataset, w.split, coalesce(h.n, 0) > 0 AND NOT (d.dataset = 'broken' AND w.split = 'test') AS present,
  CASE WHEN d.dataset = 'broken' AND w.split = 'test' THEN 'text,labels,id,original_id'
       WHEN w.split = 'validation' THEN d.missing ELSE '' END AS missing_columns,
  d.dataset = 'whole' AND coalesce(h.n, 0) > 0 OR d.dataset = 'broken' AND w.split = 'train' AS ok
FROM data d CROSS JOIN want w LEFT JOIN have h ON h.split = w.split""")
def val_splits(spark, sf):
    """VAL-02: each of the three splits is stored, has rows and carries text, labels,
    id, original_id; one status row per split. Checked on a whole dataset and on one
    stored without a test split and with a narrower validation split."""
    frame = cut_lineage(_split_frame(spark, sf))
    whole, broken = scratch_path(spark, "splits"), scratch_path(spark, "broken-splits")
    sinks.write_splits(frame, whole)
    frame.where("split = 'train'").drop("split").write.parquet(f"{broken}/split=train")
    frame.where("split = 'validation'").select("text", "id").write.parquet(f"{broken}/split=validation")
    parts = [E.check_splits(spark, p, REQUIRED).select(F.lit(name).alias("dataset"), "*")
             for name, p in (("whole", whole), ("broken", broken))]
    return parts[0].unionByName(parts[1])


@register("inspect_splits", f"""{_SPLIT_FRAME_SQL}
SELECT split, CAST(count(*) AS BIGINT) AS n, min(id) AS sample_id, arg_min(text, id) AS sample_text,
       arg_min(labels, id) AS sample_labels FROM frame GROUP BY split""")
def inspect_splits(spark, sf):
    """VAL-03: per split its size and one sample row (the lowest id)."""
    frame = _split_frame(spark, sf)
    g = frame.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                   F.min_by(F.struct("id", "text", "labels"), "id").alias("s"))
    return g.select("split", "n", F.col("s.id").alias("sample_id"),
                    F.col("s.text").alias("sample_text"), F.col("s.labels").alias("sample_labels"))


@register("snk_splits", f"""{_SPLIT_FRAME_SQL}
SELECT * FROM frame""")
def snk_splits(spark, sf):
    """SNK-02: splits written one folder per split, read back."""
    path = sinks.write_splits(_split_frame(spark, sf), scratch_path(spark, "splits"))
    return spark.read.parquet(path)


@register("snk_curated", f"""WITH {S.VERDICTS},
cur AS (SELECT *, row_number() OVER (ORDER BY pos) AS pid FROM curated),
cur2 AS (SELECT *, pid - 1 AS lid, coalesce(sentiment, 'unlabelled') AS stratum FROM cur),
{S.stratified('cur2', label='stratum', idc='lid')},
ids AS (SELECT domain, domain || '_' || {_SIZE_SQL} || '_20250101_000000_synthetic' AS dataset_id
        FROM (SELECT domain, count(*) AS n FROM split_rows GROUP BY domain))
SELECT lid AS id, pid AS original_id, pos AS doc_id, clean_text, sentiment, split, r.domain, ids.dataset_id,
       'documents.parquet' AS original_file, '20250101_000000' AS processing_timestamp
FROM split_rows r JOIN ids ON ids.domain = r.domain""")
def snk_curated(spark, sf):
    """SNK-01: full curation run publishing rows under (domain,
    dataset_id) and a metrics document per domain; returns the rows read back."""
    return sinks.published(spark, _curated(spark, sf), "processed")


def _curated(spark, sf) -> str:
    from textcurate.plans.curate import run_curation

    base = scratch_path(spark, "curated")
    res = run_curation(spark, sf, sink_dir=base, dataset_tag="synthetic")
    if res["status"] != "success":
        raise RuntimeError(res.get("message"))
    return base


@register("snk_metrics", f"""WITH {S.VERDICTS},
c AS (SELECT domain, count(*) AS total_processed, count(*) FILTER (WHERE NOT keep_len) AS length_filtered,
      count(*) FILTER (WHERE dup_type = 'exact') AS exact_duplicates, count(*) FILTER (WHERE dup_type = 'similar') AS near_duplicates,
      count(*) FILTER (WHERE keep_len AND dup_type IS NULL) AS n FROM verdict_all GROUP BY domain)
SELECT domain || '_' || {_SIZE_SQL} || '_20250101_000000_synthetic' AS dataset_id, domain, '20250101_000000' AS timestamp,
       total_processed, length_filtered, exact_duplicates, near_duplicates, n AS total_accepted FROM c""")
def snk_metrics(spark, sf):
    """SNK-01: the metrics documents that the same run publishes."""
    m = sinks.published(spark, _curated(spark, sf), "metrics")
    return normalise(m.select("dataset_id", "domain", "timestamp", *[F.col(f"summary.{c}").alias(c) for c in (
        "total_processed", "length_filtered", "exact_duplicates", "near_duplicates", "total_accepted")]))


@register("run_record", f"""WITH {S.VERDICTS}, s AS ({S.summary('verdict_all')})
SELECT '20250101_000000_synthetic' AS run, 'success' AS status, s.*, true AS timed, CAST(6 AS BIGINT) AS stages_ok FROM s""")
def run_record(spark, sf):
    """AGG-10 + PIP-01: the published record of a run: counters observed while the verdicts
    were written, wall clock not negative and divided by the reviews, every stage's outcome."""
    r = sinks.published(spark, _curated(spark, sf), "runs")
    per = F.abs(F.col("seconds_per_review") * F.col("total_processed") - F.col("seconds")) < 1e-6
    counters = [c for c in r.columns if c.startswith(("total_", "length_", "duplicates_", "exact_", "near_"))]
    return normalise(r.select("run", "status", *counters, ((F.col("seconds") >= 0) & per).alias("timed"),
                              F.size(F.filter("stages", lambda s: s["outcome"] == "ok")).alias("stages_ok")))


def _processed(rows):
    """Counters per domain of rows that no filter has seen."""
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("total_processed"))


@register("src_dataset", f"""WITH {S.REVIEWS},
ids AS (SELECT domain, domain || '_' || {_SIZE_SQL} || '_20250101_000000' AS dataset_id
        FROM (SELECT domain, count(*) AS n FROM reviews GROUP BY domain)),
pick AS (SELECT min(dataset_id) AS dataset_id FROM ids)
SELECT r.id, r.text, r.sentiment, r.domain, ids.dataset_id
FROM reviews r JOIN ids ON ids.domain = r.domain JOIN pick ON pick.dataset_id = ids.dataset_id""")
def src_dataset(spark, sf):
    """SRC-03: write curated data, then load one dataset id with partition pruning."""
    base = scratch_path(spark, "curated")
    rows = reviews(spark, sf).select("id", "text", "sentiment", "domain")
    sinks.write_curated(rows, base, _processed(rows))
    ids = sinks.published(spark, base, "metrics").orderBy("dataset_id").limit(1).collect()
    return E.load_dataset(spark, base, ids[0]["dataset_id"]).drop("original_file", "processing_timestamp")


@register("metrics_history", f"""WITH {S.REVIEWS},
n AS (SELECT count(*) AS n FROM reviews WHERE domain = 'src1'),
st(stamp) AS (VALUES ('20250101_000000'), ('20250102_000000'))
SELECT 'src1_' || {_SIZE_SQL} || '_' || stamp AS dataset_id, 'src1' AS domain, stamp AS timestamp,
       CAST(n AS BIGINT) AS total_processed FROM n, st""")
def metrics_history(spark, sf):
    """SRC-04: metrics documents of one domain, oldest first (two runs, each repeated)."""
    base = scratch_path(spark, "curated")
    counted = cut_lineage(_processed(documents(spark, sf)))
    for stamp in ["20250102_000000", "20250101_000000"] * 2:  # a repeated run replaces itself
        sinks.write_metrics(counted.withColumnRenamed("total_processed", "n"), base, counted, stamp=stamp)
    h = E.metrics_history(spark, base, "src1")
    return h.select("dataset_id", "domain", "timestamp",
                    F.col("summary.total_processed").cast("long").alias("total_processed"))


@register("snk_eval", f"""{_MM_SQL},
runs(dataset, stamp) AS (VALUES ('embeddings', '20250101_000000'), ('embeddings', '20250102_000000')),
l AS (SELECT model, metric, CAST(value AS DOUBLE) AS value
      FROM (UNPIVOT mm ON accuracy, precision, recall, f1, mcc, balanced_accuracy, combined INTO NAME metric VALUE value)
      UNION ALL SELECT m.model, 'confusion_' || t || '_' || p, CAST(count(pred.model) AS DOUBLE)
      FROM (SELECT DISTINCT model FROM pred) m CROSS JOIN range(3) a(t) CROSS JOIN range(3) b(p)
      LEFT JOIN pred ON pred.model = m.model AND y_true = t AND y_pred = p GROUP BY m.model, t, p)
SELECT model, metric, round(value, 6) AS value, dataset, stamp FROM l, runs""")
def snk_eval(spark, sf):
    """SNK-03: per-model metrics and confusion cells as (model, dataset, metric, value) of
    two runs. The first is written twice, and a third was killed before it was published:
    every run shows once."""
    pred = predictions(spark, sf)
    mm, cells = cut_lineage(LB.model_metrics(pred)), cut_lineage(M.confusion(pred, ["model"]))
    base = scratch_path(spark, "evaluations")
    for stamp in ("20250101_000000", "20250102_000000", "20250101_000000"):
        sinks.write_evaluations(mm, base, ["model"], "embeddings", stamp, cells)
    sinks.stage({"evaluations": (sinks.evaluation_rows(mm, ["model"], "embeddings", "20250103_000000"), [])}, base)
    return normalise(sinks.published(spark, base, "evaluations"))


@register("src_training_logs", f"""WITH {_LOGS_SQL}
SELECT run, step, round(eval_combined_metric, 6) AS best_metric FROM logs WHERE eval_combined_metric IS NOT NULL
ORDER BY eval_combined_metric DESC, run, step, event_id LIMIT 1""")
def src_training_logs(spark, sf):
    """SRC-07 + LDB-04: training logs written as lines of a bounded number of files,
    read back with their run, best checkpoint selected. (Trainer state files, one
    per checkpoint folder, are read by ``read_trainer_states``.)"""
    path = scratch_path(spark, "runs")
    logs = training_logs(spark, sf).select("run", "step", F.col("event_id").alias("entry"),
                                           "loss", "eval_loss", "eval_combined_metric")
    logs.write.mode("overwrite").json(path)
    back = E.read_training_logs(spark, f"{path}/*.json").withColumn("run", F.col("run").cast("long"))
    return normalise(LB.best_checkpoint(back.withColumnRenamed("entry", "event_id")))
