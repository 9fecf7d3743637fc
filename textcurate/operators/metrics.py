"""Classification metrics (MET-*).

Every count-based metric derives from the confusion counts, so a single ``groupBy``
with partial aggregation over the prediction rows produces one wide row of counters
per group (correct rows, and per class tp_k, support t_k, predicted p_k); all metrics
are then projections of that row. The classes are a parameter, the three sentiment
codes by default; ``classes_of`` reads them from the data. Labels outside the
classes are an error, not silently left out. The projections are (the named expressions in ``METRICS`` are the
user-supplied-metric registry of UDF-03). AUROC needs score order and uses a
bucketed prefix sum over distinct scores (K-RANK style), never a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.operators import rank

CLASSES = [0, 1, 2]
MOST_CLASSES = 200
NEUTRAL = 1
# Fixed values of the phase gate.
GATE_MIN_ACCURACY = 0.70
GATE_MAX_SHARE = 0.80


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    dv = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")
    return F.when(b == 0, dv).otherwise(a.cast("double") / b.cast("double"))


def classes_of(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> list[int]:
    """The labels that occur, sorted; more than MOST_CLASSES are an error, as the
    counters have three columns for each."""
    seen = pred.select(F.explode(F.array(y_true, y_pred)).alias("k")).where("k is not null").distinct().limit(MOST_CLASSES + 1).collect()
    if len(seen) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return sorted(int(r["k"]) for r in seen)


def _among(x: str, classes: Sequence[int]) -> Column:
    known = [F.lit(k) for k in classes]
    return F.coalesce(F.col(x).isin(*known), F.lit(False)) if known else F.lit(False)


def _known(x: str, classes: Sequence[int]) -> Column:
    """The label; one outside the classes is an error."""
    told = F.concat(F.lit("label outside the classes: "), F.coalesce(F.col(x).cast("string"), F.lit("null")))
    return F.when(_among(x, classes), F.col(x)).otherwise(F.raise_error(told))


def counters(pred: DataFrame, keys: Sequence[str], y_true: str = "y_true",
             y_pred: str = "y_pred", classes: Sequence[int] = CLASSES, count_unknown: bool = False) -> DataFrame:
    """One pass: per group s (rows), c (correct rows), tp_k, t_k, p_k for each class.

    With ``count_unknown`` a row with another label is no error but is counted
    beside the others: bad (how many) and first_bad (the smallest such label, as text), so
    that one failing group does not take the rest with it."""
    if count_unknown:
        bad = [F.when(~_among(x, classes), F.coalesce(F.col(x).cast("string"), F.lit("null"))) for x in (y_true, y_pred)]
        pred = pred.select(*keys, F.col(y_true).alias("_t"), F.col(y_pred).alias("_p"), F.coalesce(*bad).alias("_bad"))
    else:
        pred = pred.select(*keys, *[_known(x, classes).alias(a) for x, a in ((y_true, "_t"), (y_pred, "_p"))], F.lit(None).cast("string").alias("_bad"))
    good = F.col("_bad").isNull()
    t, p = F.when(good, F.col("_t")), F.when(good, F.col("_p"))
    aggs = [F.count_if(good).alias("s"), F.count_if(t == p).alias("c")]
    for k in classes:
        aggs += [F.count_if((t == k) & (p == k)).alias(f"tp{k}"),
                 F.count_if(t == k).alias(f"t{k}"), F.count_if(p == k).alias(f"p{k}")]
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    found = [F.count("_bad").alias("bad"), F.min("_bad").alias("first_bad")] if count_unknown else []
    out = g.agg(*aggs, *found)
    return out.select(*keys, *[F.col(c).cast("string" if c == "first_bad" else "long").alias(c) for c in out.columns if c not in keys])


def confusion(pred: DataFrame, keys: Sequence[str], classes: Sequence[int] = CLASSES) -> DataFrame:
    """MET-01: long-form grid of the classes per group (zeros included)."""
    w = counters(pred, keys, classes=classes)  # every group once; other labels are an error
    cells = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    grid = w.select(*keys).withColumn("_c", F.explode(F.array(
        *[F.struct(F.lit(i).cast("long").alias("y_true"), F.lit(j).cast("long").alias("y_pred"))
          for i in classes for j in classes]))).select(*keys, "_c.y_true", "_c.y_pred")
    out = grid.join(cells, list(keys) + ["y_true", "y_pred"], "left")
    return out.select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- per-class expressions over a counters row --------------------------------

def precision(k: int) -> Column:
    return _safe_div(F.col(f"tp{k}"), F.col(f"p{k}"))


def recall(k: int) -> Column:
    return _safe_div(F.col(f"tp{k}"), F.col(f"t{k}"))


def f1(k: int) -> Column:
    p, r = precision(k), recall(k)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))


def _seen(k: int) -> Column:
    return (F.col(f"t{k}") + F.col(f"p{k}")) > 0


def _present(k: int) -> Column:
    return F.col(f"t{k}") > 0


def _mean_over(values: list[Column], mask: list[Column]) -> Column:
    num = None
    den = None
    for v, m in zip(values, mask):
        term = F.when(m, v).otherwise(F.lit(0.0))
        cnt = F.when(m, F.lit(1)).otherwise(F.lit(0))
        num = term if num is None else num + term
        den = cnt if den is None else den + cnt
    return _safe_div(num, den)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def accuracy() -> Column:
    return _safe_div(F.col("c"), F.col("s"))


def macro(fn: Callable[[int], Column], classes: Sequence[int] = CLASSES) -> Column:
    """Mean over labels seen in truth or prediction (sklearn default labels)."""
    return _mean_over([fn(k) for k in classes], [_seen(k) for k in classes])


def weighted(fn: Callable[[int], Column], classes: Sequence[int] = CLASSES) -> Column:
    return _safe_div(_total([_d(f"t{k}") * fn(k) for k in classes]), F.col("s"))


def balanced_accuracy(classes: Sequence[int] = CLASSES) -> Column:
    return _mean_over([recall(k) for k in classes], [_present(k) for k in classes])


def mcc(classes: Sequence[int] = CLASSES) -> Column:
    s, c = _d("s"), _d("c")
    tp = _total([_d(f"t{k}") * _d(f"p{k}") for k in classes])
    pp = _total([_d(f"p{k}") * _d(f"p{k}") for k in classes])
    tt = _total([_d(f"t{k}") * _d(f"t{k}") for k in classes])
    cov_tp = c * s - tp
    cov_pp = s * s - pp
    cov_tt = s * s - tt
    den = cov_tt * cov_pp
    return F.when(den == 0, F.lit(0.0)).otherwise(cov_tp / F.sqrt(den))


def _all_classes_mean(fn_num: Callable[[int], str], fn_den: Callable[[int], str], classes: Sequence[int]) -> Column:
    """Mean over all classes of tp/den; null (the reference's NaN) if any class has
    an empty denominator."""
    parts = [F.when(F.col(fn_den(k)) == 0, F.lit(None).cast("double"))
             .otherwise(_d(fn_num(k)) / _d(fn_den(k))) for k in classes]
    return reduce(lambda a, b: a + b, parts) / len(classes)


def harmonic_block(classes: Sequence[int] = CLASSES) -> dict[str, Column]:
    """MET-14 with correct names: macro recall over all classes, macro
    precision over all classes, their harmonic mean (0 when undefined) and
    0.7 * that + 0.3 * accuracy."""
    mr = _all_classes_mean(lambda k: f"tp{k}", lambda k: f"t{k}", classes)
    mp = _all_classes_mean(lambda k: f"tp{k}", lambda k: f"p{k}", classes)
    hf = F.when(mr.isNull() | mp.isNull() | ((mr + mp) <= 0), F.lit(0.0)) \
          .otherwise(2.0 * (mr * mp) / (mr + mp))
    return {"macro_recall_all": mr, "macro_precision_all": mp, "f1_of_macros": hf,
            "combined_harmonic": 0.7 * hf + 0.3 * accuracy()}


def efficiency(samples_per_second: Column, p: Column, r: Column, classes: Sequence[int] = CLASSES) -> Column:
    """MET-15: throughput x balanced accuracy x (1 - |precision - recall|)."""
    return samples_per_second * balanced_accuracy(classes) * (1 - F.abs(p - r))


# name -> expression over a counters row, given the classes; users add their own here
METRICS: dict[str, Callable[[Sequence[int]], Column]] = {
    "accuracy": lambda ks: accuracy(),
    "macro_precision": lambda ks: macro(precision, ks),
    "macro_recall": lambda ks: macro(recall, ks),
    "macro_f1": lambda ks: macro(f1, ks),
    "weighted_precision": lambda ks: weighted(precision, ks),
    "weighted_recall": lambda ks: weighted(recall, ks),
    "weighted_f1": lambda ks: weighted(f1, ks),
    "balanced_accuracy": balanced_accuracy,
    "mcc": mcc,
    "neutral_recall": lambda ks: recall(NEUTRAL),
    "combined_half": lambda ks: 0.5 * accuracy() + 0.5 * macro(f1, ks),
    "combined_70_30": lambda ks: 0.7 * macro(f1, ks) + 0.3 * accuracy(),
    "composite": lambda ks: (0.3 * weighted(f1, ks) + 0.3 * weighted(recall, ks)
                             + 0.2 * accuracy() + 0.2 * recall(NEUTRAL)),
}


def metric_table(cnt: DataFrame, keys: Sequence[str], names: Sequence[str], classes: Sequence[int] = CLASSES) -> DataFrame:
    return cnt.select(*keys, *[METRICS[n](classes).alias(n) for n in names])


def per_class(cnt: DataFrame, keys: Sequence[str], classes: Sequence[int] = CLASSES) -> DataFrame:
    """MET-03: long form (keys, label, precision, recall, f1, support)."""
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).cast("long").alias("label"), precision(k).alias("precision"),
        recall(k).alias("recall"), f1(k).alias("f1"), F.col(f"t{k}").alias("support"))
        for k in classes])).alias("_r")
    return cnt.select(*keys, rows).select(*keys, "_r.*")


def class_scores(classes: Sequence[int], scores: str | None) -> list[Column]:
    """Score of each class, in the order of the classes: columns p<class>, or the items of
    an array column, null where the array is null or shorter."""
    return [F.get(F.col(scores), i) if scores else F.col(f"p{k}") for i, k in enumerate(classes)]


def prob_metrics(pred: DataFrame, keys: Sequence[str], classes: Sequence[int] = CLASSES, scores: str | None = None) -> DataFrame:
    """MET-09/10: Brier (mean over classes of one-vs-rest Brier) and
    calibration error (mean |p(predicted) - correct|). Without scores both are 0; a label
    outside the classes is an error."""
    p = class_scores(classes, scores)
    pred = pred.select(*keys, _known("y_true", classes).alias("_t"), _known("y_pred", classes).alias("_p"),
                       *[c.alias(f"_s{i}") for i, c in enumerate(p)])
    sq = [F.pow(F.col(f"_s{i}") - F.when(F.col("_t") == k, 1.0).otherwise(0.0), 2) for i, k in enumerate(classes)]
    p_pred = F.coalesce(*[F.when(F.col("_p") == k, F.col(f"_s{i}")) for i, k in enumerate(classes)])
    correct = F.when(F.col("_t") == F.col("_p"), 1.0).otherwise(0.0)
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    out = g.agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_b{i}") for i, x in enumerate(sq)],
                F.coalesce(F.avg(F.abs(p_pred - correct)), F.lit(0.0)).alias("calibration_error"))
    return out.select(*keys, (_total([F.col(f"_b{i}") for i in range(len(classes))]) / len(classes)).alias("brier"),
                      "calibration_error")


def auroc(pred: DataFrame, keys: Sequence[str], classes: Sequence[int] = CLASSES, scores: str | None = None) -> DataFrame:
    """MET-08: one-vs-rest AUROC per (keys, class), exact with ties:
    sum over distinct scores of pos * (neg below + neg equal / 2) / (P * N);
    a class absent from (or filling) the truth gives 0.5. A group without scores for a
    class gives 0 there, so models of any score shape stand in one table; rows without a
    score do not count. A true label outside the classes is an error.

    Distinct scores per (group, class) are first aggregated (map-side
    combine), then "negatives below" is a prefix sum computed as
    bucket offsets (small table) + a window inside one (group, class, bucket).
    """
    keys = list(keys)
    ex = pred.select(*keys, _known("y_true", classes).alias("y_true"), F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("label"), c.cast("double").alias("score"))
        for k, c in zip(classes, class_scores(classes, scores), strict=True)])).alias("_e")).select(*keys, "y_true", "_e.label", "_e.score")
    pos = F.col("y_true") == F.col("label")
    # a class without scores keeps one row, of the null score
    dist = ex.groupBy(*keys, "label", "score").agg(
        F.count_if(pos).cast("long").alias("np"), F.count_if(~pos).cast("long").alias("nn"))
    # bounds from the raw scores: a scan, no shuffle; the aggregation runs once
    b = rank.range_bucket(dist, "score", out="_sb", bounds_from=ex.select("score").where("score is not null"))
    b = b.withColumns({c: F.when(F.col("score").isNotNull(), F.col(c)).otherwise(0) for c in ("np", "nn")})
    part = keys + ["label"]
    tot = b.groupBy(*part, "_sb").agg(F.sum("nn").alias("_bn"))
    w_off = Window.partitionBy(*part).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, "_sb", F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"))
    j = rank.join_null_safe(b, off, part + ["_sb"])
    w_in = Window.partitionBy(*part, "_sb").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("nb", F.col("_off") + F.coalesce(F.sum("nn").over(w_in), F.lit(0)))
    num = F.col("np").cast("decimal(38,0)") * (2 * F.col("nb").cast("decimal(38,0)") + F.col("nn"))
    agg = j.groupBy(*part).agg(F.sum(num).alias("_num"), F.sum("np").alias("P"),
                               F.sum("nn").alias("N"))
    val = F.when((F.col("P") == 0) & (F.col("N") == 0), F.lit(0.0)).when((F.col("P") == 0) | (F.col("N") == 0), F.lit(0.5)).otherwise(
        F.col("_num").cast("double") / (2.0 * _d("P") * _d("N")))
    return agg.select(*part, val.alias("auroc"))


def phase_gate(cnt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MET-20 (declared rules): phase-2 trigger when accuracy < 0.70, all
    predictions in one class, or two or more classes never predicted; success
    needs accuracy > 0.70 and no class with >= 80 % of the predictions."""
    shares = [_safe_div(F.col(f"p{k}"), F.col("s")) for k in CLASSES]
    max_share = F.greatest(*shares)
    empty = sum(F.when(F.col(f"p{k}") == 0, 1).otherwise(0) for k in CLASSES)
    acc = accuracy()
    return cnt.select(*keys, acc.alias("accuracy"), max_share.alias("max_pred_share"),
                      empty.cast("long").alias("empty_pred_classes"),
                      ((acc < GATE_MIN_ACCURACY) | (max_share >= 1.0) | (empty >= 2)).alias("phase2"),
                      ((acc > GATE_MIN_ACCURACY) & (max_share < GATE_MAX_SHARE)).alias("success"))
