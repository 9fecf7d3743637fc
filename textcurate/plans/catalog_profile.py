"""Aggregations and profiles (AGG-*) and contract checks on them (VAL-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.functions import labels as L
from textcurate.operators import dedup, profile, splits
from textcurate.plans import curate as C
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import normalise, register
from textcurate.session import cut_lineage
from textcurate.session import scratch_path
from textcurate.sources.tables import attach_sentiment, doc_positions, documents, labelled_reviews, whole_reviews


def _verdicts(spark, sf):
    return dedup.verdicts(documents(spark, sf))


@register("filter_summary", f"""WITH {S.VERDICTS}
{S.summary('verdict_all')}""")
def filter_summary(spark, sf):
    """AGG-01: processed, length-filtered, duplicates (exact, near), removed, accepted."""
    return profile.filter_summary(_verdicts(spark, sf))


@register("filter_pct", f"""WITH {S.VERDICTS}, s AS ({S.summary('verdict_all')})
SELECT total_processed,
  {', '.join(f"{S.r(f'CASE WHEN total_processed = 0 THEN NULL ELSE {c} * 100.0 / total_processed END')} AS {c}_pct"
             for c in ['length_filtered', 'duplicates_removed', 'exact_duplicates', 'near_duplicates', 'total_removed', 'total_accepted'])}
FROM s""")
def filter_pct(spark, sf):
    """AGG-04: each counter as a percentage of processed."""
    return normalise(profile.filter_pct(profile.filter_summary(_verdicts(spark, sf))))


@register("empty_summary", f"""WITH {S.REVIEWS},
{S.PREPARED},
short AS (SELECT *, CAST(NULL AS VARCHAR) AS dup_type FROM prepared WHERE word_count < 5)
{S.summary('short')}""")
def empty_summary(spark, sf):
    """AGG-11: the batch where nothing survives -- the reviews whose cleaned text
    is under five words all fail the length filter; counters stay consistent
    (removed = processed, accepted = 0)."""
    # every text is cleaned once: the short ones are read by each branch of the verdicts
    rows = cut_lineage(dedup.prepare(documents(spark, sf)).drop("text").where(F.col("word_count") < 5))
    return profile.filter_summary(dedup.verdicts(rows, prepared=True))


@register("reconcile", f"""WITH {S.VERDICTS},
p AS (SELECT source AS domain, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT domain, count(*) AS n FROM verdict_all WHERE NOT keep_len OR dup_type IS NOT NULL GROUP BY domain),
k AS (SELECT 'curated' AS relation, domain, count(*) AS n FROM curated GROUP BY domain
      UNION ALL SELECT 'labelled', domain, count(*) FROM curated WHERE sentiment IS NOT NULL GROUP BY domain),
r(relation) AS (VALUES ('curated'), ('labelled'))
SELECT r.relation, p.domain, CAST(p.n AS BIGINT) AS total_processed, CAST(coalesce(k.n, 0) AS BIGINT) AS total_accepted,
  CAST(coalesce(m.n, 0) AS BIGINT) AS total_removed, coalesce(k.n, 0) + coalesce(m.n, 0) = p.n AS reconciled
FROM r CROSS JOIN p LEFT JOIN k ON k.relation = r.relation AND k.domain = p.domain LEFT JOIN m ON m.domain = p.domain""")
def reconcile(spark, sf):
    """VAL-04 per domain: what was stored plus what was removed must equal what came
    in. The three are counted apart: rows of the documents table, removed verdicts,
    and rows of an accepted relation; for the curated rows they agree, for those
    that have a label they do not where some have none."""
    v = cut_lineage(_verdicts(spark, sf).select("id", "domain", "keep_len", "dup_type"))
    kept = attach_sentiment(v.where(F.col("keep_len") & F.col("dup_type").isNull()).select("id", "domain"), spark, sf)
    processed = documents(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return profile.reconcile(processed, v.where(~F.col("keep_len") | F.col("dup_type").isNotNull()),
                             {"curated": kept, "labelled": kept.where("sentiment is not null")})


@register("sentiment_dist", f"""WITH {S.VERDICTS},
dim(sentiment) AS (VALUES ('negative'), ('neutral'), ('positive')),
c AS (SELECT sentiment, count(*) AS n FROM curated GROUP BY sentiment)
SELECT d.sentiment, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM dim d LEFT JOIN c ON c.sentiment = d.sentiment""")
def sentiment_dist(spark, sf):
    """AGG-02: final label distribution of the curated rows, three classes always."""
    v = _verdicts(spark, sf)
    cur = v.where(F.col("keep_len") & F.col("dup_type").isNull()).select("id")
    return profile.sentiment_dist(spark, attach_sentiment(cur, spark, sf))


@register("label_dist", f"""WITH {S.LABELLED},
{S.stratified('labelled')},
c AS (SELECT split, sentiment, count(*) AS n FROM split_rows GROUP BY split, sentiment)
SELECT split, sentiment, CAST(n AS BIGINT) AS n, {S.r('n * 100.0 / sum(n) OVER (PARTITION BY split)')} AS pct FROM c""")
def label_dist(spark, sf):
    """AGG-03: observed label distribution with percentages, per split."""
    lab = labelled_reviews(spark, sf).select("id", "sentiment")
    sp = splits.stratified_split(lab, "sentiment", "id")
    return normalise(profile.label_dist(sp, "split", "sentiment"))


@register("imbalance", f"""WITH {S.LABELLED},
c AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment),
r AS (SELECT max(n) AS mx, min(n) AS mn FROM c)
SELECT CAST(mx AS BIGINT) AS max_class, CAST(mn AS BIGINT) AS min_class,
       {S.r('CAST(mx AS DOUBLE) / mn')} AS imbalance_ratio, CAST(mx AS DOUBLE) / mn > 10 AS imbalanced FROM r""")
def imbalance(spark, sf):
    """AGG-05: class imbalance ratio, flagged above 10."""
    return normalise(profile.imbalance(labelled_reviews(spark, sf), "sentiment"))


_DRIFT_BASE = f"""WITH {S.LABELLED},
r AS (SELECT {S.research_domain('domain')} AS domain, {S.LABEL_IDX} AS label_idx FROM labelled)"""


@register("domain_drift", f"""{_DRIFT_BASE},
c AS (SELECT domain, label_idx, count(*) AS n FROM r GROUP BY domain, label_idx),
grid AS (SELECT d.domain, k.label_idx FROM (SELECT DISTINCT domain FROM c) d, (VALUES (0), (1), (2)) k(label_idx)),
fullc AS (SELECT g.domain, g.label_idx, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN c ON c.domain = g.domain AND c.label_idx = g.label_idx),
act AS (SELECT *, n / sum(n) OVER (PARTITION BY domain) AS actual FROM fullc),
{S.MIX}
SELECT a.domain, CAST(a.label_idx AS BIGINT) AS label_idx, {S.r('a.actual')} AS actual, {S.r('m.expected')} AS expected,
       {S.r('a.actual - m.expected')} AS difference,
       CASE WHEN m.expected IS NULL THEN 'No research distribution available for comparison' END AS warning
FROM act a LEFT JOIN mix m ON m.domain = a.domain AND m.label_idx = a.label_idx""")
def domain_drift(spark, sf):
    """AGG-06: observed vs published label mix per research domain."""
    lab = labelled_reviews(spark, sf).select(
        profile.research_domain(F.col("domain")).alias("domain"),
        L.encode_label("sentiment").alias("label_idx"))
    return normalise(profile.domain_drift(spark, lab, "domain", "label_idx"))


@register("domain_drift_file", f"""WITH {S.LABELLED},
r AS (SELECT domain AS source, {S.research_domain('domain')} AS research, {S.LABEL_IDX} AS label_idx FROM labelled),
sh AS (SELECT research, label_idx, count(*) / sum(count(*)) OVER (PARTITION BY research) AS expected FROM r GROUP BY research, label_idx),
mix AS (SELECT DISTINCT r.source, k.label_idx, coalesce(sh.expected, 0) AS expected FROM r CROSS JOIN range(3) k(label_idx)
        LEFT JOIN sh ON sh.research = r.research AND sh.label_idx = k.label_idx WHERE r.research <> 'retail'),
c AS (SELECT source, label_idx, count(*) AS n FROM r GROUP BY ALL),
act AS (SELECT g.source, k.label_idx, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.source) AS actual
        FROM (SELECT DISTINCT source FROM c) g CROSS JOIN range(3) k(label_idx) LEFT JOIN c ON c.source = g.source AND c.label_idx = k.label_idx)
SELECT a.source AS domain, CAST(a.label_idx AS BIGINT) AS label_idx, {S.r('a.actual')} AS actual, {S.r('m.expected')} AS expected,
       {S.r('a.actual - m.expected')} AS difference,
       CASE WHEN m.expected IS NULL THEN 'No research distribution available for comparison' END AS warning
FROM act a LEFT JOIN mix m ON m.source = a.source AND m.label_idx = a.label_idx""")
def domain_drift_file(spark, sf):
    """SRC-06 + AGG-06: a mix file with an entry for most sources (the shares of their
    research domain), written, read and compared with the label mix of every source."""
    lab = labelled_reviews(spark, sf).select("domain", profile.research_domain(F.col("domain")).alias("research"),
                                             L.encode_label("sentiment").alias("label_idx"))
    shares = lab.groupBy("research").agg(F.array(*[F.count_if(F.col("label_idx") == i) / F.count(F.lit(1)) for i in range(3)]).alias("distribution"))
    entries = lab.select("domain", "research").distinct().join(shares.where("research <> 'retail'"), "research")
    path = scratch_path(spark, "mix")
    document = F.map_from_entries(F.collect_list(F.struct("domain", F.struct("distribution"))))
    entries.agg(F.to_json(document).alias("value")).write.text(path)  # an entry per source
    return normalise(profile.domain_drift(spark, lab, "domain", "label_idx", profile.read_mix(spark, path)))


@register("class_weights", f"""{_DRIFT_BASE},
{S.MIX},
w AS (SELECT domain, label_idx, 1.0 / (expected + CAST(1e-5 AS DOUBLE)) AS raw FROM mix),
w2 AS (SELECT domain, label_idx, raw / sum(raw) OVER (PARTITION BY domain) * 3.0 AS weight FROM w),
grid AS (SELECT d.domain, k.label_idx FROM (SELECT DISTINCT domain FROM r) d, (VALUES (0), (1), (2)) k(label_idx))
SELECT g.domain, CAST(g.label_idx AS BIGINT) AS label_idx, {S.r('coalesce(w2.weight, 1.0)')} AS weight
FROM grid g LEFT JOIN w2 ON w2.domain = g.domain AND w2.label_idx = g.label_idx""")
def class_weights(spark, sf):
    """AGG-07: inverse-frequency class weights of the domain mix, scaled to sum 3;
    domains without a mix get ones."""
    lab = labelled_reviews(spark, sf).select(profile.research_domain(F.col("domain")).alias("domain"))
    return normalise(profile.class_weights(spark, lab, "domain"))


@register("dataset_fingerprint", f"""WITH {S.WHOLE},
f AS (SELECT CAST(id AS VARCHAR) AS a, text AS b, sentiment AS c FROM whole),
h AS (SELECT md5(coalesce(len(a) || ':' || a, '-') || '|' || coalesce(len(b) || ':' || b, '-') || '|' || coalesce(len(c) || ':' || c, '-')) AS h FROM f)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(('0x' || substr(h, 1, 16))::UBIGINT), 0) AS VARCHAR) AS content_sum,
  CAST(coalesce(sum(('0x' || substr(h, 17, 16))::UBIGINT), 0) AS VARCHAR) AS content_sum2 FROM h""")
def dataset_fingerprint(spark, sf):
    """AGG-08: order-free fingerprint of the dataset (all rows)."""
    return profile.fingerprint(whole_reviews(spark, sf), ["id", "text", "sentiment"])


@register("dataset_card", f"""WITH {S.LABELLED}
SELECT 'documents' AS dataset, CAST(count(*) AS BIGINT) AS num_samples,
  CAST(count(*) FILTER (WHERE sentiment = 'positive') AS BIGINT) AS positive,
  CAST(count(*) FILTER (WHERE sentiment = 'neutral') AS BIGINT) AS neutral,
  CAST(count(*) FILTER (WHERE sentiment = 'negative') AS BIGINT) AS negative
FROM labelled""")
def dataset_card(spark, sf):
    """AGG-09: dataset card -- name, samples and label distribution."""
    lab = labelled_reviews(spark, sf)
    return lab.agg(F.lit("documents").alias("dataset"),
                   F.count(F.lit(1)).cast("long").alias("num_samples"),
                   *[F.count_if(F.col("sentiment") == x).cast("long").alias(x)
                     for x in ["positive", "neutral", "negative"]])
