"""Driver tables and the mapping of them onto the review / prediction model.

Every relation here is a lazy DataFrame over the parquet files, so Catalyst
prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# The simulated models -- m<k> errs on every k-th row; c0 always
# predicts class 0 (a degenerate model that the anomaly rules must catch).
MODEL_MODULI = [3, 5, 7, 11]
CONSTANT_MODEL = "c0"
NUM_CLASSES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Session setting: partitions that the text tables are dealt into after the scan.
# Unset, the scan's own splits are used, at every size.
INPUT_PARTITIONS = "spark.textcurate.inputPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals the rows of a scan by ``key`` into as many partitions as the session asks
    for: for tables stored in fewer splits than there are cores."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def doc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review order key alone (cheap scan: one column) -- used for
    quantile bucket bounds of K-RANK over ``pos``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"))


def sentiment_of(quality, toxic):
    """labels row -> review sentiment: toxic -> negative; quality 0 -> neutral;
    else positive."""
    return (F.when(toxic == 1, "negative").when(quality == 0, "neutral")
            .otherwise("positive"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows without labels: id, pos (input order key), text, domain.

    ``pos`` is the document id: the input order of the review stream. Plans
    that do not need the label (cleaning, duplicates) start here, so the raw
    text is never shuffled for the label join."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text",
        F.col("source").alias("domain"))


def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        sentiment_of(F.col("quality"), F.col("toxic")).alias("sentiment"))


def attach_sentiment(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-join the label of each row by id (late, on narrow relations).
    AQE turns it into a broadcast when the labels are small at runtime."""
    return df.join(sentiments(spark, sf_dir), "id", "left")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows: id, pos (input order key), text, domain, sentiment (nullable)."""
    return attach_sentiment(documents(spark, sf_dir), spark, sf_dir)


UNLABELLED = "unlabelled"


def whole_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews; those without a label are a stratum of their own. For everything in
    which the label is a payload, not the subject."""
    return reviews(spark, sf_dir).withColumn("sentiment", F.coalesce("sentiment", F.lit(UNLABELLED)))


def labelled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that carry a label (inner join)."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text",
        F.col("source").alias("domain"))
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        sentiment_of(F.col("quality"), F.col("toxic")).alias("sentiment"))
    return docs.join(lab, "id", "inner")


def _softmax3(e0, e1, e2):
    x0, x1, x2 = F.exp(e0), F.exp(e1), F.exp(e2)
    s = x0 + x1 + x2
    return x0 / s, x1 / s, x2 / s


def predictions(spark: SparkSession, sf_dir: str, source: str = "embeddings") -> DataFrame:
    """Prediction rows: model, domain, row_id, y_true, y_pred, p0, p1, p2.

    embeddings: y_true = label % 3; model m<k> predicts (label + [vec_id % k = 0]) % 3;
    scores are the softmax of the first three embedding components.
    events (large variant): y_true = event_id % 3, same error rule on event_id,
    logits from integer residues of event_id and user_id.
    """
    if source == "embeddings":
        base = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("row_id"),
            F.concat(F.lit("d"), (F.col("vec_id") % 4).cast("string")).alias("domain"),
            (F.col("label") % 3).cast("long").alias("y_true"),
            F.col("label").cast("long").alias("raw"),
            F.element_at("embedding", 1).cast("double").alias("e0"),
            F.element_at("embedding", 2).cast("double").alias("e1"),
            F.element_at("embedding", 3).cast("double").alias("e2"))
    elif source == "events":
        # Scores are ratios of small integers (no exp): correctly rounded in any
        # engine, and with many exact ties -- the hard case for AUROC.
        ev = table(spark, sf_dir, "events")
        w = [(((F.col("event_id") * (2 * k + 3) + F.col("user_id")) % 89) + 1).cast("double")
             for k in range(3)]
        tot = w[0] + w[1] + w[2]
        base = ev.select(
            F.col("event_id").alias("row_id"),
            F.col("event_type").alias("domain"),
            (F.col("event_id") % 3).cast("long").alias("y_true"),
            (F.col("event_id") % 3).cast("long").alias("raw"),
            *[(w[k] / tot).alias(f"p{k}") for k in range(3)])
    else:
        raise ValueError(f"unknown prediction source {source!r}")
    if source == "embeddings":
        p0, p1, p2 = _softmax3(F.col("e0"), F.col("e1"), F.col("e2"))
        base = base.select("row_id", "domain", "y_true", "raw",
                           p0.alias("p0"), p1.alias("p1"), p2.alias("p2"))
    # One row per (model, input row): a narrow explode, no shuffle.
    specs = [F.struct(F.lit(f"m{m}").alias("model"), F.lit(m).alias("modulus")) for m in MODEL_MODULI]
    specs.append(F.struct(F.lit(CONSTANT_MODEL).alias("model"), F.lit(0).alias("modulus")))
    out = base.select("*", F.explode(F.array(*specs)).alias("_m"))
    err = F.when(F.col("row_id") % F.col("_m.modulus") == 0, 1).otherwise(0)
    y_pred = F.when(F.col("_m.modulus") == 0, F.lit(0)).otherwise((F.col("raw") + err) % 3)
    return out.select(F.col("_m.model").alias("model"), "domain", "row_id", "y_true",
                      y_pred.cast("long").alias("y_pred"), "p0", "p1", "p2")


# How events are read as training-log entries.
TRAIN_EVENT = "view"
EVAL_EVENT = "purchase"
METRIC_EVENT = "signup"


def training_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries: run, step, event_id, loss, eval_loss, eval_combined_metric.

    run = user_id; step = hours since 2024-01-01; a 'view' event logs a train
    loss, a 'purchase' an eval loss, a 'signup' a combined metric (value/500).
    """
    ev = table(spark, sf_dir, "events")
    # whole hours since the origin; timezone-free for TIMESTAMP_NTZ columns
    step = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("long")
    v = F.col("value").cast("double")
    return ev.select(
        F.col("user_id").alias("run"), step.alias("step"), "event_id",
        F.when(F.col("event_type") == TRAIN_EVENT, v / 100).alias("loss"),
        F.when(F.col("event_type") == EVAL_EVENT, v / 100).alias("eval_loss"),
        F.when(F.col("event_type") == METRIC_EVENT, v / 500).alias("eval_combined_metric"),
        F.col("ts"))
