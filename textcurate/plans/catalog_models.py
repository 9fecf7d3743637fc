"""Model-backed queries (UDF-01/02, ML-01, AUG-05/06). The hashed encoder and
the naive Bayes scorer are restated in SQL (same md5 term buckets, same
smoothing), and so is the softmax regression (ML-01), a step per CTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.functions import labels as L
from textcurate.functions import text as T
from textcurate.operators import augment as A
from textcurate.operators import profile, scoring, splits
from textcurate.plans import sqlparts as S
from textcurate.plans.catalog_augment import _FALLBACK as PHRASES
from textcurate.plans.catalog_augment import _aug_sql as AUG_SQL
from textcurate.plans.registry import normalise, register
from textcurate.session import cut_lineage
from textcurate.sources.tables import labelled_reviews, table


def _bucket(t: str, dim: int) -> str:
    return f"CAST(('0x' || substr(md5({t}), 1, 8))::UBIGINT % {dim} AS BIGINT)"


_CLASS_WEIGHTS = {"healthcare": (0.15, 0.25, 0.60)}  # fixed values: the published shares of the classes
_STEPS, _RATE, _L2 = 30, 4.0, 0.0005


def _softmax_sql() -> str:
    """CTEs ending in probs(id, y, c, p): softmax regression by full-batch gradient steps
    on the labelled partition, every step a CTE of weights."""
    dim = scoring.SCORER_DIM
    shares = ", ".join(f"({c}, {s})" for c, s in enumerate(_CLASS_WEIGHTS["healthcare"]))
    parts = [S.LABELLED, f"lab AS (SELECT id, {S.clean_strict('text')} AS ct, {S.LABEL_IDX} AS y FROM labelled)",
             "n AS (SELECT count(*) AS n FROM lab)",
             f"part AS (SELECT lab.*, row_number() OVER (ORDER BY {S.shuffle_key('id')}, id) AS rk FROM lab)",
             f"sh(c, share) AS (VALUES {shares})", "cw AS (SELECT c, 3 * (1 / (CAST(share AS DOUBLE) + 1e-5)) / (SELECT sum(1 / (CAST(share AS DOUBLE) + 1e-5)) FROM sh) AS cw FROM sh)",
             "docs AS MATERIALIZED (SELECT part.id, part.y, cw.cw, rk <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS train, ct FROM part, n LEFT JOIN cw ON cw.c = part.y)",
             f"tf AS (SELECT id, {_bucket('tok', dim)} AS b, count(*) AS n FROM (SELECT id, {_TOKS} AS tok FROM docs) GROUP BY ALL)",
             "x AS MATERIALIZED (SELECT id, b, CAST(n AS DOUBLE) / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY id)) AS x FROM tf UNION ALL SELECT id, -1, 1.0 FROM docs)",
             "w0 AS MATERIALIZED (SELECT b, c, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT b FROM x), range(3) t(c))",
             "total AS (SELECT sum(cw) AS total FROM docs WHERE train)"]

    def probs(k: int, rows: str) -> str:
        return f"""(SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS p FROM (SELECT id, c, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM
  (SELECT x.id, w.c, sum(x.x * w.w) AS s FROM x JOIN docs USING (id) JOIN w{k} w USING (b) WHERE {rows} GROUP BY x.id, w.c)))"""
    for k in range(_STEPS):
        parts.append(f"r{k} AS MATERIALIZED (SELECT d.id, q.c, cw * (p - CASE WHEN y = q.c THEN 1 ELSE 0 END) AS r FROM {probs(k, 'train')} q JOIN docs d USING (id))")
        parts.append(f"g{k} AS (SELECT b, c, sum(x * r) AS g FROM x JOIN r{k} USING (id) GROUP BY b, c)")
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT b, c, w - {_RATE} * (coalesce(g, 0) / total + CASE WHEN b < 0 THEN 0 ELSE {_L2} END * w) AS w FROM total, w{k} LEFT JOIN g{k} USING (b, c))")
    parts.append(f"probs AS MATERIALIZED (SELECT id, CASE WHEN train THEN y ELSE -1 END AS y, q.c, p FROM {probs(_STEPS, 'true')} q JOIN docs USING (id))")
    return ",\n".join(parts)


_TOKS = "unnest(regexp_extract_all(lower(ct), '[a-z0-9]+'))"

_EMBED_SQL = f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS ct FROM documents),
t AS (SELECT id, {_TOKS} AS tok FROM c),
b AS (SELECT id, {_bucket('tok', scoring.EMBED_DIM)} AS dim, count(*) AS n FROM t GROUP BY ALL),
nrm AS (SELECT id, sqrt(sum(CAST(n AS DOUBLE) * CAST(n AS DOUBLE))) AS z FROM b GROUP BY id)
SELECT b.id, b.dim, round(CAST(n AS DOUBLE) / z, 6) AS value FROM b JOIN nrm ON nrm.id = b.id"""


def _nb_sql(docs: str, docs_cte: str = "") -> str:
    """CTEs ending in ``probs(id, p0, p1, p2, label)``: naive Bayes trained on
    the labelled partition, scoring the rows of ``docs(id, ct)``."""
    dim = scoring.SCORER_DIM
    return f"""{docs_cte}{S.LABELLED},
lab AS (SELECT id, {S.clean_strict('text')} AS ct, {S.LABEL_IDX} AS y FROM labelled),
n AS (SELECT count(*) AS n FROM lab),
part AS (SELECT lab.*, row_number() OVER (ORDER BY {S.shuffle_key('id')}, id) AS rk FROM lab),
train AS (SELECT part.* FROM part, n WHERE rk <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)),
rest AS (SELECT part.* FROM part, n WHERE rk > CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)),
tt AS (SELECT y, {_bucket('tok', dim)} AS b FROM (SELECT y, {_TOKS} AS tok FROM train)),
cnt AS (SELECT y, b, count(*) AS c FROM tt GROUP BY y, b),
cls(y) AS (VALUES (0), (1), (2)),
tot AS (SELECT cls.y, coalesce(sum(cnt.c), 0) AS tc FROM cls LEFT JOIN cnt ON cnt.y = cls.y GROUP BY cls.y),
pri AS (SELECT cls.y, count(train.id) AS pc FROM cls LEFT JOIN train ON train.y = cls.y GROUP BY cls.y),
nt AS (SELECT count(*) AS nt FROM train),
lp AS (SELECT pri.y, ln((CAST(pc AS DOUBLE) + 1.0) / (CAST(nt AS DOUBLE) + 3.0)) AS lp FROM pri, nt),
dt AS (SELECT id, {_bucket('tok', dim)} AS b FROM (SELECT id, {_TOKS} AS tok FROM {docs})),
ll AS (SELECT dt.id, cls.y, sum(ln((CAST(coalesce(cnt.c, 0) AS DOUBLE) + 1.0) / (CAST(tot.tc AS DOUBLE) + {dim}.0))) AS s
       FROM dt, cls JOIN tot ON tot.y = cls.y LEFT JOIN cnt ON cnt.y = cls.y AND cnt.b = dt.b
       GROUP BY dt.id, cls.y),
sc AS (SELECT d.id, cls.y, lp.lp + coalesce(ll.s, 0.0) AS s FROM {docs} d, cls
       JOIN lp ON lp.y = cls.y LEFT JOIN ll ON ll.id = d.id AND ll.y = cls.y),
mx AS (SELECT id, max(s) AS m FROM sc GROUP BY id),
ex AS (SELECT sc.id, sc.y, exp(sc.s - mx.m) AS e FROM sc JOIN mx ON mx.id = sc.id),
z AS (SELECT id, sum(e) AS zs FROM ex GROUP BY id),
pp AS (SELECT ex.id, max(CASE WHEN y = 0 THEN e / zs END) AS p0, max(CASE WHEN y = 1 THEN e / zs END) AS p1,
              max(CASE WHEN y = 2 THEN e / zs END) AS p2 FROM ex JOIN z ON z.id = ex.id GROUP BY ex.id),
probs AS (SELECT id, p0, p1, p2,
          CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS label FROM pp)"""


def _partitioned(spark, sf):
    lab = labelled_reviews(spark, sf).select("id", T.clean_strict("text").alias("text"), "sentiment")
    part = splits.partition_labeled(lab, "id", "sentiment")
    return part.withColumn("label_idx", L.encode_label("sentiment"))


def _naive_bayes(part):
    return scoring.train_naive_bayes(part.where("is_labeled"), "text", "label_idx")


@register("embed", _EMBED_SQL)
def embed(spark, sf):
    """UDF-01: every document -> unit vector (hashed bag of words, Arrow
    batches), reported sparse: (id, dim, value) for the non-zero components."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                             T.clean_strict("text").alias("text"))
    e = scoring.embed(d, "text").select("id", F.posexplode("embedding").alias("dim", "value"))
    return normalise(e.where(F.col("value") != 0))


_DOCS_CTE = f"docs AS (SELECT doc_id AS id, {S.clean_strict('text')} AS ct FROM documents),\n"


@register("score", f"""WITH {_nb_sql('docs', _DOCS_CTE)}
SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, label FROM probs""")
def score(spark, sf):
    """UDF-02: every document -> class scores from the naive Bayes scorer
    trained on the labelled partition, plus the argmax label."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                             T.clean_strict("text").alias("text"))
    s = scoring.score(d, "text", _naive_bayes(_partitioned(spark, sf)))
    return normalise(s.select("id", *[F.element_at("scores", k + 1).alias(f"p{k}") for k in range(3)],
                              L.argmax("scores").alias("label")))


@register("train_score", f"""WITH {_softmax_sql()}
SELECT id, CAST(any_value(y) AS BIGINT) AS label_idx, CAST(arg_max(c, (p, -c)) AS BIGINT) AS pred,
  round(max(p) FILTER (c = 0), 6) AS p0, round(max(p) FILTER (c = 1), 6) AS p1, round(max(p) FILTER (c = 2), 6) AS p2 FROM probs GROUP BY id""")
def train_score(spark, sf):
    """ML-01: class-weighted softmax regression (weights from the healthcare
    mix, AGG-07) trained on the labelled partition; scores every labelled review, those
    whose label is hidden (label_idx -1) too."""
    part = cut_lineage(_partitioned(spark, sf))
    dom = spark.createDataFrame([("healthcare",)], "domain string")
    weights = {r["label_idx"]: r["weight"] for r in profile.class_weights(spark, dom, "domain").collect()}
    model = scoring.train_softmax(part.where("is_labeled"), "text", "label_idx", weights, steps=_STEPS, rate=_RATE, l2=_L2)
    s = scoring.score(part, "text", model)
    return normalise(s.select("id", F.coalesce("label_idx", F.lit(-1)).alias("label_idx"), L.argmax("scores").alias("pred"),
                              *[F.element_at("scores", k + 1).alias(f"p{k}") for k in range(3)]))


@register("relabel", f"""WITH {_nb_sql('rest')}
SELECT r.id, r.ct AS text, ['negative', 'neutral', 'positive'][p.label + 1] AS sentiment
FROM rest r JOIN probs p ON p.id = r.id""")
def relabel(spark, sf):
    """AUG-05: re-label the unlabelled partition with the batch scorer."""
    part = cut_lineage(_partitioned(spark, sf))
    return scoring.relabel(part.where(~F.col("is_labeled")).select("id", "text"), "text", _naive_bayes(part))


@register("augment_e2e", f"""WITH {_nb_sql('rest')},
ph AS (SELECT {PHRASES} AS phrases),
comb AS (SELECT id, ct, ['negative', 'neutral', 'positive'][y + 1] AS sentiment FROM train
         UNION ALL
         SELECT r.id, r.ct, ['negative', 'neutral', 'positive'][p.label + 1] FROM rest r JOIN probs p ON p.id = r.id),
aug AS (SELECT CAST(id AS VARCHAR) || '_orig' AS id, ct AS text, id AS source_id, sentiment FROM comb
        UNION ALL
        SELECT CAST(id AS VARCHAR) || '_aug', {AUG_SQL('ct', 'id')}, id, sentiment FROM comb),
na AS (SELECT count(*) AS n FROM aug),
rk AS (SELECT aug.*, row_number() OVER (ORDER BY {S.shuffle_key('id')}, id) AS r FROM aug)
SELECT id, text, source_id, sentiment,
  CASE WHEN r <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train'
       WHEN r <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) + CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'validation'
       ELSE 'test' END AS split,
  CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS BIGINT) AS label
FROM rk, na""")
def augment_e2e(spark, sf):
    """AUG-06: partition -> re-label -> original + augmented rows -> 80/10/10
    split -> label codes. (Splitting after duplication can separate a row from
    its variant, as in the reference; ``group_by_source`` below keeps them
    together.)"""
    return augment_pipeline(spark, sf)


def augment_pipeline(spark, sf, group_by_source: bool = False):
    # read by the training, the scoring and the output: partitioned once
    part = cut_lineage(_partitioned(spark, sf))
    labelled = part.where("is_labeled").select("id", "text", "sentiment")
    relabelled = scoring.relabel(part.where(~F.col("is_labeled")).select("id", "text"), "text", _naive_bayes(part))
    combined = labelled.unionByName(relabelled)
    rows = A.augmented_rows(combined, "id", "text", "sentiment", A.phrase_table(spark))
    key = "source_id" if group_by_source else "id"
    if group_by_source:
        sp = splits.sequential_split(rows.select("source_id").distinct(), "source_id")
        rows = rows.join(sp, "source_id")
    else:
        rows = splits.sequential_split(rows, key)
    code = L.encode_label("sentiment")
    return rows.withColumn("label", F.when(code.isNull(), F.raise_error(F.lit("unknown label")))
                           .otherwise(code).cast("long"))
