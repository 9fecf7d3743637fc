"""Aggregations and profiles (AGG-*): every counter is one pass of partial
aggregates; small results (one row per class, per split or per domain) are the
only things windowed or broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions.labels import LABELS

# Published domain mixes [negative, neutral, positive] and the
# smoothing constant of the class-weight formula.
DOMAIN_MIX = {
    "healthcare": [0.15, 0.25, 0.60],
    "finance": [0.30, 0.40, 0.30],
    "technology": [0.10, 0.35, 0.55],
}
WEIGHT_EPS = 1e-5
IMBALANCE_LIMIT = 10
# Fixture mapping of document sources onto research domains (k % 4).
RESEARCH_DOMAINS = ["healthcare", "finance", "technology", "retail"]


def research_domain(source: Column) -> Column:
    k = F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % len(RESEARCH_DOMAINS)
    return F.get(F.array(*[F.lit(d) for d in RESEARCH_DOMAINS]), k.cast("int"))


def mix_table(spark) -> DataFrame:
    """Domain mix as long-form rows (domain, label, label_idx, expected): a
    fixed nine-row dimension, safe to broadcast."""
    rows = [(d, LABELS[i], i, float(p)) for d, dist in DOMAIN_MIX.items() for i, p in enumerate(dist)]
    return spark.createDataFrame(rows, "domain string, label string, label_idx int, expected double")


def expand_classes(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """Every key row repeated once per class: a broadcast equi-join on a
    constant with the fixed three-row class table."""
    return (keys.withColumn("_k", F.lit(0))
            .join(F.broadcast(classes.withColumn("_k", F.lit(0))), "_k").drop("_k"))


def run_counters() -> list[Column]:
    """The four counters of a run over verdict rows, for ``agg`` or ``observe``."""
    return [F.count(F.lit(1)).alias("total_processed"),
            F.count_if(~F.col("keep_len")).alias("length_filtered"),
            F.count_if(F.col("dup_type") == "exact").alias("exact_duplicates"),
            F.count_if(F.col("dup_type") == "similar").alias("near_duplicates")]


def with_totals(c: dict) -> dict:
    """The summary of observed counters, as ``filter_summary`` has it."""
    dups = c["exact_duplicates"] + c["near_duplicates"]
    removed = c["length_filtered"] + dups
    return {"total_processed": c["total_processed"], "length_filtered": c["length_filtered"], "duplicates_removed": dups,
            "exact_duplicates": c["exact_duplicates"], "near_duplicates": c["near_duplicates"], "total_removed": removed,
            "total_accepted": c["total_processed"] - removed}


def filter_summary(verdicts: DataFrame, by: str | None = None) -> DataFrame:
    """AGG-01: one row of counters (or one per value of ``by``); total_removed =
    length-filtered + duplicates."""
    agg = (verdicts.groupBy(by) if by else verdicts.groupBy()).agg(*run_counters())
    keys = [by] if by else []
    agg = agg.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in agg.columns if c not in keys])
    dups = F.col("exact_duplicates") + F.col("near_duplicates")
    return agg.select(
        *keys, "total_processed", "length_filtered", dups.alias("duplicates_removed"),
        "exact_duplicates", "near_duplicates",
        (F.col("length_filtered") + dups).alias("total_removed"),
        (F.col("total_processed") - F.col("length_filtered") - dups).alias("total_accepted"))


def filter_pct(summary: DataFrame) -> DataFrame:
    """AGG-04: every counter as a percentage of processed (null when 0 rows)."""
    n = F.col("total_processed")
    cols = ["length_filtered", "duplicates_removed", "exact_duplicates", "near_duplicates",
            "total_removed", "total_accepted"]
    return summary.select(n, *[F.when(n == 0, F.lit(None).cast("double"))
                               .otherwise(F.col(c) * 100.0 / n).alias(f"{c}_pct") for c in cols])


def reconcile(processed: DataFrame, removed: DataFrame, accepted: dict[str, DataFrame], by: str = "domain") -> DataFrame:
    """VAL-04: per accepted relation and ``by``: total_processed (from ``processed``: by,
    n), total_accepted and total_removed (rows counted), reconciled."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias(name))

    out = None
    for name, rows in accepted.items():
        one = processed
        for frame, column in ((rows, "a"), (removed, "r")):
            c = counted(frame, f"_{column}")
            one = one.join(c, one[by].eqNullSafe(c["_by"]), "left").drop("_by")
        one = one.select(F.lit(name).alias("relation"), by, F.col("n").cast("long").alias("total_processed"),
                         F.coalesce("_a", F.lit(0)).cast("long").alias("total_accepted"),
                         F.coalesce("_r", F.lit(0)).cast("long").alias("total_removed"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("reconciled", F.col("total_accepted") + F.col("total_removed") == F.col("total_processed"))


def read_mix(spark, path: str) -> DataFrame:
    """SRC-06: published mixes from a JSON file {domain: {"distribution": [...]}}, as
    the rows of ``mix_table``; a missing file gives no rows, so every domain gets
    balanced weights."""
    from pyspark.errors import AnalysisException

    schema = "map<string, struct<distribution: array<double>>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    rows = text.select(F.explode(F.from_json("value", schema)).alias("domain", "m")).select(
        "domain", F.posexplode("m.distribution").alias("label_idx", "expected"))
    return rows.select("domain", F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("label_idx") + 1).alias("label"),
                       F.col("label_idx").cast("int").alias("label_idx"), "expected")


def sentiment_dist(spark, rows: DataFrame, label: str = "sentiment") -> DataFrame:
    """AGG-02: the three classes always present (0 if none); others ignored."""
    dim = spark.createDataFrame([(x,) for x in LABELS], f"{label} string")
    counts = rows.where(F.col(label).isin(*LABELS)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, label, "left").select(
        label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_dist(rows: DataFrame, group: str, label: str) -> DataFrame:
    """AGG-03: observed labels per group with percentage of the group."""
    c = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(group))
    return c.select(group, label, F.col("n").cast("long").alias("n"),
                    (F.col("n") * 100.0 / tot).alias("pct"))


def imbalance(rows: DataFrame, label: str) -> DataFrame:
    """AGG-05: max / min class count, flagged above 10."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    r = c.agg(F.max("n").alias("max_class"), F.min("n").alias("min_class"))
    ratio = F.col("max_class").cast("double") / F.col("min_class")
    return r.select(F.col("max_class").cast("long"), F.col("min_class").cast("long"),
                    ratio.alias("imbalance_ratio"), (ratio > IMBALANCE_LIMIT).alias("imbalanced"))


def domain_drift(spark, rows: DataFrame, domain: str, label_idx: str, mix: DataFrame | None = None) -> DataFrame:
    """AGG-06: per domain and class: actual share, expected share, difference;
    a domain without a published mix keeps only the actual share, with a warning.
    ``mix``: other published mixes than the built-in ones, see ``read_mix``."""
    c = rows.groupBy(domain, label_idx).agg(F.count(F.lit(1)).alias("n"))
    # all three classes per observed domain (bincount with minlength 3)
    doms = c.select(domain).distinct()
    classes = spark.createDataFrame([(i,) for i in range(len(LABELS))], f"{label_idx} int")
    grid = expand_classes(doms, classes)
    full = grid.join(c, [domain, label_idx], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    actual = F.col("n") / F.sum("n").over(Window.partitionBy(domain))
    full = full.withColumn("actual", actual)
    published = F.broadcast(mix_table(spark)) if mix is None else mix
    mix = published.select(F.col("domain").alias(domain), F.col("label_idx").alias(label_idx), "expected")
    out = full.join(mix, [domain, label_idx], "left")
    return out.select(domain, F.col(label_idx).cast("long").alias(label_idx), "actual", "expected",
                      (F.col("actual") - F.col("expected")).alias("difference"),
                      F.when(F.col("expected").isNull(),
                             F.lit("No research distribution available for comparison"))
                      .alias("warning"))


def class_weights(spark, domains: DataFrame, domain: str, mix: DataFrame | None = None) -> DataFrame:
    """AGG-07: w = 1 / (p + 1e-5) scaled to sum 3 per domain; unknown -> ones. ``mix``:
    other published mixes than the built-in ones, see ``read_mix``."""
    mix = mix if mix is not None else mix_table(spark)
    w = mix.withColumn("raw", 1.0 / (F.col("expected") + WEIGHT_EPS))
    w = w.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("domain")) * 3.0)
    w = F.broadcast(w.select(F.col("domain").alias(domain), "label_idx", "weight"))
    classes = spark.createDataFrame([(i,) for i in range(len(LABELS))], "label_idx int")
    grid = expand_classes(domains.select(domain).distinct(), classes)
    out = grid.join(w, [domain, "label_idx"], "left")
    return out.select(domain, F.col("label_idx").cast("long").alias("label_idx"),
                      F.coalesce("weight", F.lit(1.0)).alias("weight"))


def fingerprint(rows: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-08: order-free content fingerprint over all rows: count, and the sums of
    the two halves of md5(row) as decimal strings. Each field enters with its
    length, so different rows never read alike."""
    def field(c: str) -> Column:
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    h = F.md5(F.concat_ws("|", *[field(c) for c in cols]))

    def total(at: int) -> Column:
        v = F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")
        return F.coalesce(F.sum(v), F.lit(0).cast("decimal(38,0)")).cast("string")

    return rows.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), total(1).alias("content_sum"), total(17).alias("content_sum2"))
