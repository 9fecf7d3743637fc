"""Review envelopes, curated datasets, metrics history and training logs
(SRC-01..04, SRC-07).

An envelope is {"domain": ..., "generated_data": [{id, text, sentiment}, ...],
"summary": {...}}. A file holds either pretty-printed envelopes (one task per file)
or one envelope per line (split across tasks, which is what large inputs should use);
a folder may hold both. Records that are not JSON, or lack the two required fields, are
rows of their own or an error, as the caller asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.labels import encode_label_lenient
from textcurate.sources import sinks

REVIEW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])
ENVELOPE = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("generated_data", T.ArrayType(REVIEW)),
    T.StructField("summary", T.StructType([
        T.StructField("total_generated", T.LongType()),
        T.StructField("sentiment_distribution", T.StructType([
            T.StructField("positive", T.LongType()), T.StructField("neutral", T.LongType()),
            T.StructField("negative", T.LongType())])),
    ])),
])
LOG_ENTRY = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("entry", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_combined_metric", T.DoubleType()),
])


BAD = "_bad_record"
RECORD = T.StructType([*ENVELOPE.fields, T.StructField(BAD, T.StringType())])
# A file above this many bytes without a line that is an envelope is read by line: it
# cannot be one document (no row holds that much), so its lines come back as bad records.
WHOLE_FILE_BYTES = 256 << 20


# JSON strings hold no line break and members are parted by commas, so a brace that closes
# before a line break and one that opens after it belong to two documents.
DOCUMENT_BREAK = r"(?<=\})[ \t\r]*\n\s*(?=\{)"


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file and their order in it: a large file is read in
    blocks by several tasks, each numbering its lines upwards."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.where(F.col("value").rlike(r"\S"))


def _is_envelope_line(value: Column) -> Column:
    """One whole JSON object with a field of an envelope. No line inside a document that
    spans several lines is one: reviews have other fields."""
    keys = F.json_object_keys(value)
    return F.coalesce(F.arrays_overlap(keys, F.array(F.lit("domain"), F.lit("generated_data"))), F.lit(False))


def _parsed(texts: DataFrame) -> DataFrame:
    """``value``, one JSON document each, as records. A list gives a record per item. What does not parse is
    one bad record with its text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    value = F.col("value")
    items = F.from_json(value, T.ArrayType(ENVELOPE), {"mode": "PERMISSIVE"})
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in ENVELOPE.fields]
    from_list = F.transform(items, lambda e: F.struct(*[e[f.name].alias(f.name) for f in ENVELOPE.fields], F.lit(None).cast("string").alias(BAD)))
    one = F.when(value.rlike(r"^\s*\["), F.coalesce(from_list, F.array(F.struct(*empty, value.alias(BAD))))) \
           .otherwise(F.array(F.from_json(value, RECORD, options)))
    return texts.select("file", F.explode(one).alias("e")).select("e.*", "file")


def envelope_records(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The envelopes as stored: domain, generated_data, summary, the raw text of a record
    that does not parse (else null), file.

    Every file has the layout that it shows itself: if any of its lines is an envelope,
    its records are its lines, and a line that is none is one bad record. Otherwise the file
    holds documents that span lines, one or several after each other; only such files are
    put together, one task each. So one bad record costs nothing but itself.
    ``multi_line`` states one layout for all files."""
    lines = _file_lines(spark, path)
    if multi_line is False:
        return _parsed(lines)
    if multi_line:
        by_line, whole = None, lines
    else:
        layout = lines.groupBy("file").agg((F.bool_or(_is_envelope_line(F.col("value"))) | (F.max("bytes") > WHOLE_FILE_BYTES))
                                           .alias("by_line"))
        known = lines.join(layout, "file")
        by_line, whole = known.where("by_line"), known.where("not by_line")
    texts = whole.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("l")).select(
        "file", F.array_join(F.col("l.value"), "\n").alias("text"))
    documents = texts.select("file", F.explode(F.split("text", DOCUMENT_BREAK)).alias("value"))
    return _parsed(documents) if by_line is None else _parsed(by_line.select("file", "value").unionByName(documents))


def envelope_checks(records: DataFrame) -> DataFrame:
    """VAL-01, one row per stored envelope: has_domain, has_generated_data,
    n_reviews, valid (parsed, both fields there, at least one review)."""
    n = F.coalesce(F.size("generated_data"), F.lit(0))
    has_domain, has_data = F.col("domain").isNotNull(), F.col("generated_data").isNotNull()
    return records.select("domain", "file", has_domain.alias("has_domain"), has_data.alias("has_generated_data"),
                          F.greatest(n, F.lit(0)).cast("long").alias("n_reviews"),
                          (F.col(BAD).isNull() & has_domain & has_data & (n > 0)).alias("valid"))


def _is_bad() -> Column:
    return F.col("domain").isNull() | F.col("generated_data").isNull() | F.col(BAD).isNotNull()


def review_rows(records: DataFrame) -> DataFrame:
    """One row per review of the good envelopes: domain, id, text, sentiment, file, pos."""
    rows = records.where(~_is_bad()).select("domain", "file", F.posexplode("generated_data").alias("pos", "r"))
    return rows.select("domain", "r.id", "r.text", "r.sentiment", "file", F.col("pos").cast("long").alias("pos"))


def bad_records(records: DataFrame) -> DataFrame:
    """The records that are no envelope: file, domain if any, reason, and the raw text
    where it does not parse."""
    reason = (F.when(F.col(BAD).isNotNull(), "not JSON of an envelope").when(F.col("domain").isNull(), "domain is missing")
              .otherwise("generated_data is missing"))
    return records.where(_is_bad()).select("file", "domain", reason.alias("reason"), F.col(BAD).alias("raw"))


def read_envelopes(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """SRC-01: one row per review with its position in its envelope -> columns
    domain, id, text, sentiment, file, pos. A record that is no envelope raises
    (``review_rows`` and ``bad_records`` of ``envelope_records`` part them instead)."""
    env = envelope_records(spark, path, multi_line)
    told = F.concat(F.lit("not an envelope: "), F.col("file"), F.lit(": "), F.substring(F.coalesce(F.col(BAD), F.lit("a field is missing")), 1, 200))
    # in the exploded column itself: the plan may drop null arrays before the explode,
    # but not without computing this
    env = env.withColumn("generated_data", F.when(_is_bad(), F.raise_error(told)).otherwise(F.col("generated_data")))
    rows = env.select("domain", "file", F.posexplode("generated_data").alias("pos", "r"))
    return rows.select("domain", "r.id", "r.text", "r.sentiment", "file",
                       F.col("pos").cast("long").alias("pos"))


def eval_rows(df: DataFrame, text: str = "text", sentiment: str = "sentiment") -> DataFrame:
    """SRC-02: text + integer label; label trimmed, lower-cased, unknown -> neutral."""
    return df.select(F.col(text).alias("text"), encode_label_lenient(sentiment).cast("long")
                     .alias("label"), *[c for c in df.columns if c not in (text, sentiment)])


def load_dataset(spark: SparkSession, base: str, dataset_id: str) -> DataFrame:
    """SRC-03: curated rows of one dataset id published below ``base`` (partition pruning on
    the dataset_id directory); a missing id is an error."""
    df = sinks.published(spark, base, "processed").where(F.col("dataset_id") == dataset_id)
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"dataset {dataset_id!r} is not stored below {base}")
    return df


def check_splits(spark: SparkSession, path: str, required: list[str],
                 wanted: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """VAL-02 on a dataset as stored, one folder per split: split, present (there and
    not empty), missing_columns (comma-joined, from the stored schema), ok."""
    from pyspark.errors import AnalysisException

    out = None
    for name in wanted:
        try:
            rows = spark.read.parquet(f"{path}/split={name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows = spark.createDataFrame([], T.StructType([]))
        missing = ",".join(c for c in required if c not in rows.columns)
        one = rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("present")).select(
            F.lit(name).alias("split"), "present", F.lit(missing).alias("missing_columns"),
            (F.col("present") & F.lit(not missing)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def metrics_history(spark: SparkSession, base: str, domain: str) -> DataFrame:
    """SRC-04: metrics documents of one domain, oldest first. Filtering the
    domain column (not a file-name prefix) keeps 'a' from matching 'a_b'."""
    return sinks.published(spark, base, "metrics").where(F.col("domain") == domain).orderBy("dataset_id")


def dataset_metrics(spark: SparkSession, base: str, dataset_id: str) -> DataFrame:
    """SRC-04: the metrics document of one dataset, its domain among its columns."""
    return sinks.published(spark, base, "metrics").where(F.col("dataset_id") == dataset_id)


def read_training_logs(spark: SparkSession, glob: str) -> DataFrame:
    """SRC-07: log entries kept as one entry per line, with their run (a name)."""
    return spark.read.schema(T.StructType([T.StructField("run", T.StringType()), *LOG_ENTRY.fields])).json(glob)


TRAINER_STATE = T.StructType([T.StructField("best_metric", T.DoubleType()), T.StructField("global_step", T.LongType()),
                              T.StructField("log_history", T.ArrayType(LOG_ENTRY))])


def read_trainer_states(spark: SparkSession, glob: str) -> DataFrame:
    """SRC-07: trainer state files ``<run>/checkpoint-<n>/trainer_state.json``, one
    JSON document each, as log entries: run and checkpoint (folder names), entry
    (position in the history), step, loss, eval_loss, eval_combined_metric. A file
    that does not parse raises."""
    df = spark.read.schema(TRAINER_STATE).json(glob, multiLine=True, mode="FAILFAST")
    path = F.split(F.col("_metadata.file_path"), "/")
    named = df.select(F.element_at(path, -3).alias("run"), F.element_at(path, -2).alias("checkpoint"),
                      F.posexplode("log_history").alias("entry", "e"))
    return named.select("run", "checkpoint", F.col("entry").cast("long").alias("entry"), "e.step", "e.loss", "e.eval_loss",
                        "e.eval_combined_metric")
