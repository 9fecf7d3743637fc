"""Classification metrics queries (MET-*) over the simulated prediction
tables. The SQL side restates each formula with the same operation order."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.operators import metrics as M
from textcurate.plans.registry import normalise, register
from textcurate.session import cut_lineage
from textcurate.sources.tables import predictions

# ---------------------------------------------------------------- SQL pieces

_SOFTMAX = ", ".join(
    f"exp(e{k}) / (exp(e0) + exp(e1) + exp(e2)) AS p{k}" for k in range(3))
_MODELS = "(VALUES ('m3', 3), ('m5', 5), ('m7', 7), ('m11', 11), ('c0', 0)) mm(model, modulus)"


def pred_sql(source: str = "embeddings") -> str:
    if source == "embeddings":
        base = """SELECT vec_id AS row_id, 'd' || CAST(vec_id % 4 AS VARCHAR) AS domain,
         CAST(label % 3 AS BIGINT) AS y_true, CAST(label AS BIGINT) AS raw,
         CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1,
         CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings"""
    else:
        base = """SELECT event_id AS row_id, event_type AS domain,
         CAST(event_id % 3 AS BIGINT) AS y_true, CAST(event_id % 3 AS BIGINT) AS raw,
         CAST((event_id * 3 + user_id) % 89 + 1 AS DOUBLE) AS w0,
         CAST((event_id * 5 + user_id) % 89 + 1 AS DOUBLE) AS w1,
         CAST((event_id * 7 + user_id) % 89 + 1 AS DOUBLE) AS w2 FROM events"""
        return f"""pbase AS ({base}),
pb2 AS (SELECT row_id, domain, y_true, raw, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1,
        w2 / (w0 + w1 + w2) AS p2 FROM pbase),
pred AS (SELECT model, domain, row_id, y_true,
         CAST(CASE WHEN modulus = 0 THEN 0 ELSE (raw + CASE WHEN row_id % modulus = 0 THEN 1 ELSE 0 END) % 3 END AS BIGINT) AS y_pred,
         p0, p1, p2 FROM pb2, {_MODELS})"""
    return f"""pbase AS ({base}),
pb2 AS (SELECT row_id, domain, y_true, raw, {_SOFTMAX} FROM pbase),
pred AS (SELECT model, domain, row_id, y_true,
         CAST(CASE WHEN modulus = 0 THEN 0 ELSE (raw + CASE WHEN row_id % modulus = 0 THEN 1 ELSE 0 END) % 3 END AS BIGINT) AS y_pred,
         p0, p1, p2 FROM pb2, {_MODELS})"""


def cnt_sql(keys: str) -> str:
    cols = ", ".join(
        f"count(*) FILTER (WHERE y_true = {k} AND y_pred = {k}) AS tp{k}, "
        f"count(*) FILTER (WHERE y_true = {k}) AS t{k}, count(*) FILTER (WHERE y_pred = {k}) AS p{k}"
        for k in range(3))
    return f"cnt AS (SELECT {keys}, count(*) AS s, {cols} FROM pred GROUP BY {keys})"


def _div(a: str, b: str, default: str = "0.0") -> str:
    return f"(CASE WHEN {b} = 0 THEN {default} ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def sprec(k): return _div(f"tp{k}", f"p{k}")
def srec(k): return _div(f"tp{k}", f"t{k}")


def sf1(k):
    p, r = sprec(k), srec(k)
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2.0 * {p} * {r} / ({p} + {r}) END)"


def _mean_over(vals, masks):
    num = " + ".join(f"(CASE WHEN {m} THEN {v} ELSE 0.0 END)" for v, m in zip(vals, masks))
    den = " + ".join(f"(CASE WHEN {m} THEN 1 ELSE 0 END)" for m in masks)
    return _div(f"({num})", f"({den})")


def smacro(fn): return _mean_over([fn(k) for k in range(3)], [f"(t{k} + p{k}) > 0" for k in range(3)])


def sweighted(fn):
    num = " + ".join(f"CAST(t{k} AS DOUBLE) * {fn(k)}" for k in range(3))
    return _div(f"({num})", "s")


SACC = _div("(tp0 + tp1 + tp2)", "s")
SBAL = _mean_over([srec(k) for k in range(3)], [f"t{k} > 0" for k in range(3)])


def _dd(c): return f"CAST({c} AS DOUBLE)"


_TP = " + ".join(f"{_dd(f't{k}')} * {_dd(f'p{k}')}" for k in range(3))
_PP = " + ".join(f"{_dd(f'p{k}')} * {_dd(f'p{k}')}" for k in range(3))
_TT = " + ".join(f"{_dd(f't{k}')} * {_dd(f't{k}')}" for k in range(3))
_C = f"({_dd('tp0')} + {_dd('tp1')} + {_dd('tp2')})"
SMCC = (f"(CASE WHEN ({_dd('s')} * {_dd('s')} - ({_TT})) * ({_dd('s')} * {_dd('s')} - ({_PP})) = 0 THEN 0.0 "
        f"ELSE ({_C} * {_dd('s')} - ({_TP})) / sqrt(({_dd('s')} * {_dd('s')} - ({_TT})) * "
        f"({_dd('s')} * {_dd('s')} - ({_PP}))) END)")

SQL_METRICS = {
    "accuracy": SACC,
    "macro_precision": smacro(sprec), "macro_recall": smacro(srec), "macro_f1": smacro(sf1),
    "weighted_precision": sweighted(sprec), "weighted_recall": sweighted(srec),
    "weighted_f1": sweighted(sf1), "balanced_accuracy": SBAL, "mcc": SMCC,
    "neutral_recall": srec(1),
    "combined_half": f"0.5 * {SACC} + 0.5 * {smacro(sf1)}",
    "combined_70_30": f"0.7 * {smacro(sf1)} + 0.3 * {SACC}",
    "composite": f"0.3 * {sweighted(sf1)} + 0.3 * {sweighted(srec)} + 0.2 * {SACC} + 0.2 * {srec(1)}",
}


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def metric_sql(names, keys="model", source="embeddings") -> str:
    sel = ", ".join(f"{r6(SQL_METRICS[n])} AS {n}" for n in names)
    return f"WITH {pred_sql(source)},\n{cnt_sql(keys)}\nSELECT {keys}, {sel} FROM cnt"


def auroc_sql(keys: str) -> str:
    return f"""ex AS (SELECT {keys}, y_true, k AS label, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score
       FROM pred, (VALUES (0), (1), (2)) kk(k)),
agg AS (SELECT {keys}, label, score, count(*) FILTER (WHERE y_true = label) AS np,
               count(*) FILTER (WHERE y_true <> label) AS nn FROM ex GROUP BY {keys}, label, score),
cum AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY {keys}, label ORDER BY score
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM agg),
au AS (SELECT {keys}, CAST(label AS BIGINT) AS label,
   CASE WHEN sum(np) = 0 OR sum(nn) = 0 THEN 0.5
        ELSE CAST(sum(np * (2 * nb + nn)) AS DOUBLE) / (2.0 * CAST(sum(np) AS DOUBLE) * CAST(sum(nn) AS DOUBLE)) END AS auroc
   FROM cum GROUP BY {keys}, label)"""


def prob_sql(keys: str) -> str:
    b = " + ".join(f"avg(pow(p{k} - CASE WHEN y_true = {k} THEN 1.0 ELSE 0.0 END, 2))" for k in range(3))
    return f"""pm AS (SELECT {keys}, ({b}) / 3 AS brier,
   avg(abs(CASE y_pred WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END - CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)) AS calibration_error
   FROM pred GROUP BY {keys})"""


# ------------------------------------------------------------- the queries

def _pred(spark, sf, source="embeddings"):
    return predictions(spark, sf, source)


def _metric(names, keys=("model",)):
    def run(spark, sf):
        cnt = M.counters(_pred(spark, sf), list(keys))
        return normalise(M.metric_table(cnt, list(keys), names))
    return run


@register("confusion", f"""WITH {pred_sql()},
grid AS (SELECT m.model, t.k AS y_true, p.k AS y_pred FROM (SELECT DISTINCT model FROM pred) m,
         (VALUES (0), (1), (2)) t(k), (VALUES (0), (1), (2)) p(k)),
c AS (SELECT model, y_true, y_pred, count(*) AS n FROM pred GROUP BY model, y_true, y_pred)
SELECT g.model, CAST(g.y_true AS BIGINT) AS y_true, CAST(g.y_pred AS BIGINT) AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN c ON c.model = g.model AND c.y_true = g.y_true AND c.y_pred = g.y_pred""")
def confusion(spark, sf):
    """MET-01: fixed 3 x 3 confusion counts per model."""
    return M.confusion(_pred(spark, sf), ["model"])


register("accuracy", metric_sql(["accuracy"]))(_metric(["accuracy"]))
register("macro_prf", metric_sql(["macro_precision", "macro_recall", "macro_f1"]))(
    _metric(["macro_precision", "macro_recall", "macro_f1"]))
register("weighted_prf", metric_sql(["weighted_precision", "weighted_recall", "weighted_f1"]))(
    _metric(["weighted_precision", "weighted_recall", "weighted_f1"]))
register("balanced_accuracy", metric_sql(["balanced_accuracy"]))(_metric(["balanced_accuracy"]))
register("mcc", metric_sql(["mcc"]))(_metric(["mcc"]))
register("combined_half", metric_sql(["combined_half"]))(_metric(["combined_half"]))
register("combined_70_30", metric_sql(["combined_70_30"]))(_metric(["combined_70_30"]))
register("composite", metric_sql(["composite", "weighted_f1", "weighted_recall", "neutral_recall"]))(
    _metric(["composite", "weighted_f1", "weighted_recall", "neutral_recall"]))


@register("per_class_prf", f"""WITH {pred_sql()},
{cnt_sql('model')}
SELECT model, CAST(k AS BIGINT) AS label,
  {r6("CASE k WHEN 0 THEN " + sprec(0) + " WHEN 1 THEN " + sprec(1) + " ELSE " + sprec(2) + " END")} AS precision,
  {r6("CASE k WHEN 0 THEN " + srec(0) + " WHEN 1 THEN " + srec(1) + " ELSE " + srec(2) + " END")} AS recall,
  {r6("CASE k WHEN 0 THEN " + sf1(0) + " WHEN 1 THEN " + sf1(1) + " ELSE " + sf1(2) + " END")} AS f1,
  CAST(CASE k WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS BIGINT) AS support
FROM cnt, (VALUES (0), (1), (2)) kk(k)""")
def per_class_prf(spark, sf):
    """MET-03: per-class precision / recall (0 when undefined) and F1."""
    return normalise(M.per_class(M.counters(_pred(spark, sf), ["model"]), ["model"]))


@register("auroc_ovr", f"""WITH {pred_sql('events')},
{auroc_sql('model')}
SELECT model, label, {r6('auroc')} AS auroc FROM au""")
def auroc_ovr(spark, sf):
    """MET-08: one-vs-rest AUROC per model and class (large variant on events)."""
    return normalise(M.auroc(_pred(spark, sf, "events"), ["model"]))


_SHAPES_SQL = f"""WITH {pred_sql().replace('pred AS', 'pred0 AS', 1)},
pred AS (SELECT model, domain, row_id, y_true, y_pred, CASE WHEN model <> 'm7' THEN p0 END AS p0, CASE WHEN model <> 'm7' THEN p1 END AS p1,
         CASE WHEN model NOT IN ('m7', 'm11') THEN p2 END AS p2 FROM pred0)"""


@register("auroc_any_shape", f"""{_SHAPES_SQL},
{auroc_sql('model')}
SELECT model, label, {r6("CASE WHEN model = 'm7' OR model = 'm11' AND label = 2 THEN 0 ELSE auroc END")} AS auroc FROM au""")
def auroc_any_shape(spark, sf):
    """MET-08 on score vectors: one model has none, one lacks the last class; they give 0 there."""
    pred = _pred(spark, sf)
    vector = F.array("p0", "p1", "p2")
    shaped = F.when(F.col("model") == "m7", F.lit(None)).when(F.col("model") == "m11", F.slice(vector, 1, 2)).otherwise(vector)
    return normalise(M.auroc(pred.select("model", "y_true", shaped.alias("scores")), ["model"], scores="scores"))


@register("brier", f"""WITH {pred_sql()},
{prob_sql('model')}
SELECT model, {r6('brier')} AS brier FROM pm""")
def brier(spark, sf):
    """MET-09: mean over classes of the one-vs-rest Brier score."""
    return normalise(M.prob_metrics(_pred(spark, sf), ["model"]).select("model", "brier"))


@register("calibration_error", f"""WITH {pred_sql()},
{prob_sql('model')}
SELECT model, {r6('calibration_error')} AS calibration_error FROM pm""")
def calibration_error(spark, sf):
    """MET-10: mean |p(predicted class) - correct|."""
    return normalise(M.prob_metrics(_pred(spark, sf), ["model"]).select("model", "calibration_error"))


def _harm_sql():
    mr = "(" + " + ".join(f"(CASE WHEN t{k} = 0 THEN NULL ELSE CAST(tp{k} AS DOUBLE) / CAST(t{k} AS DOUBLE) END)"
                          for k in range(3)) + ") / 3"
    mp = "(" + " + ".join(f"(CASE WHEN p{k} = 0 THEN NULL ELSE CAST(tp{k} AS DOUBLE) / CAST(p{k} AS DOUBLE) END)"
                          for k in range(3)) + ") / 3"
    hf = f"(CASE WHEN {mr} IS NULL OR {mp} IS NULL OR ({mr} + {mp}) <= 0 THEN 0.0 ELSE 2.0 * ({mr} * {mp}) / ({mr} + {mp}) END)"
    return mr, mp, hf


_MR, _MP, _HF = _harm_sql()


@register("harmonic_f1", f"""WITH {pred_sql()},
{cnt_sql('model')}
SELECT model, {r6(_MR)} AS macro_recall_all, {r6(_MP)} AS macro_precision_all, {r6(_HF)} AS f1_of_macros,
  {r6(f'0.7 * {_HF} + 0.3 * {SACC}')} AS combined_harmonic FROM cnt""")
def harmonic_f1(spark, sf):
    """MET-14 with correct names (the reference swaps precision and recall)."""
    cnt = M.counters(_pred(spark, sf), ["model"])
    return normalise(cnt.select("model", *[c.alias(n) for n, c in M.harmonic_block().items()]))


@register("derived_scores", f"""WITH {pred_sql()},
{cnt_sql('model')}
SELECT model, {r6(f'(1 + {SMCC}) / 2')} AS reliability_score,
  {r6(f'CASE WHEN ({_MP}) + ({_MR}) > 0 THEN 2 * (({_MP}) * ({_MR})) / (({_MP}) + ({_MR})) ELSE 0.0 END')} AS balanced_score,
  {r6(f's / 60.0 * ({SBAL}) * (1 - abs(({_MP}) - ({_MR})))')} AS efficiency_score,
  {r6(SBAL)} AS balanced_accuracy FROM cnt""")
def derived_scores(spark, sf):
    """MET-15: reliability (1 + MCC) / 2, balanced = 2PR / (P + R) of the reported
    precision and recall, and efficiency = samples per second x balanced accuracy x
    (1 - |P - R|). The throughput is an input column; here it is the rows of a model
    over one minute."""
    cnt = M.counters(_pred(spark, sf), ["model"]).withColumn("samples_per_second", F.col("s") / 60.0)
    h = M.harmonic_block()
    p, r = h["macro_precision_all"], h["macro_recall_all"]
    bal = F.when(F.coalesce(p + r, F.lit(0.0)) > 0, 2 * (p * r) / (p + r)).otherwise(F.lit(0.0))
    return normalise(cnt.select("model", ((1 + M.mcc()) / 2).alias("reliability_score"),
                                bal.alias("balanced_score"),
                                M.efficiency(F.col("samples_per_second"), p, r).alias("efficiency_score"),
                                M.balanced_accuracy().alias("balanced_accuracy")))


def domain_report_df(spark, sf):
    # the counters, the rank sums and their bounds and the Brier scores all read it: cut once
    pred = cut_lineage(_pred(spark, sf))
    keys = ["model", "domain"]
    cnt = M.counters(pred, keys)
    base = cnt.select(*keys, M.accuracy().alias("accuracy"), M.macro(M.f1).alias("macro_f1"),
                      *[M.precision(k).alias(f"precision_{k}") for k in M.CLASSES],
                      *[M.recall(k).alias(f"recall_{k}") for k in M.CLASSES])
    au = M.auroc(pred, keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("label") == k, F.col("auroc"))).alias(f"auroc_{k}") for k in M.CLASSES])
    pm = M.prob_metrics(pred, keys)
    return base.join(au, keys).join(pm, keys)


@register("domain_report", f"""WITH {pred_sql()},
{cnt_sql('model, domain')},
{auroc_sql('model, domain')},
{prob_sql('model, domain')},
aw AS (SELECT model, domain, max(auroc) FILTER (WHERE label = 0) AS auroc_0,
       max(auroc) FILTER (WHERE label = 1) AS auroc_1, max(auroc) FILTER (WHERE label = 2) AS auroc_2
       FROM au GROUP BY model, domain)
SELECT c.model, c.domain, {r6(SACC)} AS accuracy, {r6(smacro(sf1))} AS macro_f1,
  {', '.join(f'{r6(sprec(k))} AS precision_{k}' for k in range(3))},
  {', '.join(f'{r6(srec(k))} AS recall_{k}' for k in range(3))},
  {', '.join(f'{r6(f"aw.auroc_{k}")} AS auroc_{k}' for k in range(3))},
  {r6('pm.brier')} AS brier, {r6('pm.calibration_error')} AS calibration_error
FROM cnt c JOIN aw ON aw.model = c.model AND aw.domain = c.domain
JOIN pm ON pm.model = c.model AND pm.domain = c.domain""")
def domain_report(spark, sf):
    """MET-16: full report per model and domain (MET-01..10)."""
    return normalise(domain_report_df(spark, sf))


@register("cross_domain", f"""WITH {pred_sql()},
{cnt_sql('model, domain')},
m AS (SELECT model, domain, {SACC} AS accuracy, {smacro(sf1)} AS macro_f1 FROM cnt)
SELECT model, domain, {r6('avg(accuracy)')} AS mean_accuracy, {r6('avg(macro_f1)')} AS mean_macro_f1
FROM m GROUP BY GROUPING SETS ((model, domain), (model))""")
def cross_domain(spark, sf):
    """MET-17: per model the mean accuracy and macro-F1 over domains (domain
    null) plus the per-domain values, via grouping sets."""
    cnt = M.counters(_pred(spark, sf), ["model", "domain"])
    m = cnt.select("model", "domain", M.accuracy().alias("accuracy"), M.macro(M.f1).alias("macro_f1"))
    g = m.groupingSets([["model", "domain"], ["model"]], "model", "domain").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"))
    return normalise(g)


# The compared pair of simulated models.
BASE_MODEL, TUNED_MODEL = "m3", "m5"


@register("pair_compare", f"""WITH {pred_sql()},
{cnt_sql('model')},
w AS (SELECT model, {SACC} AS accuracy, {smacro(sf1)} AS macro_f1,
      {', '.join(f'{sf1(k)} AS f1_{k}' for k in range(3))} FROM cnt WHERE model IN ('{BASE_MODEL}', '{TUNED_MODEL}')),
cm AS (SELECT model, 'cm_' || CAST(y_true AS VARCHAR) || '_' || CAST(y_pred AS VARCHAR) AS metric, CAST(count(*) AS DOUBLE) AS value
       FROM pred WHERE model IN ('{BASE_MODEL}', '{TUNED_MODEL}') GROUP BY model, y_true, y_pred),
l AS (UNPIVOT w ON accuracy, macro_f1, f1_0, f1_1, f1_2 INTO NAME metric VALUE value
      UNION ALL SELECT model, metric, value FROM cm)
SELECT metric, {r6(f"max(value) FILTER (WHERE model = '{BASE_MODEL}')")} AS base,
       {r6(f"max(value) FILTER (WHERE model = '{TUNED_MODEL}')")} AS tuned,
       {r6(f"coalesce(max(value) FILTER (WHERE model = '{TUNED_MODEL}'), 0) - coalesce(max(value) FILTER (WHERE model = '{BASE_MODEL}'), 0)")} AS delta
FROM l GROUP BY metric""")
def pair_compare(spark, sf):
    """MET-19: base vs tuned model -- accuracy, macro-F1, per-class F1 and the
    confusion cells, long form with the delta (pivot on model)."""
    pred = _pred(spark, sf).where(F.col("model").isin(BASE_MODEL, TUNED_MODEL))
    cnt = M.counters(pred, ["model"])
    w = cnt.select("model", M.accuracy().alias("accuracy"), M.macro(M.f1).alias("macro_f1"),
                   *[M.f1(k).alias(f"f1_{k}") for k in M.CLASSES])
    lw = w.unpivot("model", ["accuracy", "macro_f1", "f1_0", "f1_1", "f1_2"], "metric", "value")
    cm = pred.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select("model", F.concat(F.lit("cm_"), F.col("y_true").cast("string"), F.lit("_"),
                                  F.col("y_pred").cast("string")).alias("metric"), "value")
    p = lw.unionByName(cm).groupBy("metric").pivot("model", [BASE_MODEL, TUNED_MODEL]).agg(F.max("value"))
    p = p.withColumnsRenamed({BASE_MODEL: "base", TUNED_MODEL: "tuned"})
    return normalise(p.withColumn("delta", F.coalesce("tuned", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))))


_SH = [f"(CASE WHEN s = 0 THEN 0.0 ELSE CAST(p{k} AS DOUBLE) / CAST(s AS DOUBLE) END)" for k in range(3)]
_EMPTY = " + ".join(f"(CASE WHEN p{k} = 0 THEN 1 ELSE 0 END)" for k in range(3))


@register("phase_gate", f"""WITH {pred_sql()},
{cnt_sql('model')}
SELECT model, {r6(SACC)} AS accuracy, {r6(f'greatest({", ".join(_SH)})')} AS max_pred_share,
  CAST({_EMPTY} AS BIGINT) AS empty_pred_classes,
  ({SACC} < 0.7 OR greatest({', '.join(_SH)}) >= 1.0 OR ({_EMPTY}) >= 2) AS phase2,
  ({SACC} > 0.7 AND greatest({', '.join(_SH)}) < 0.8) AS success
FROM cnt""")
def phase_gate(spark, sf):
    """MET-20 (declared): phase-2 triggers and the success criterion per model."""
    return normalise(M.phase_gate(M.counters(_pred(spark, sf), ["model"]), ["model"]))
