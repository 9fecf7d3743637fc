"""Ids, shuffles, samples and splits (IDX-*, SMP-*, SPL-*, PRT-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.operators import dedup, splits
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import register
from textcurate.sources.tables import doc_positions, documents, labelled_reviews, table

_CURATED_SQL = f"""WITH {S.REVIEWS},
{S.PREPARED},
{S.vectors('prepared')},
flags AS (SELECT j.*,
  EXISTS (SELECT 1 FROM vrows2 k WHERE k.dup_key = j.dup_key AND k.pos < j.pos) AS is_exact,
  EXISTS (SELECT 1 FROM vrows2 k JOIN sims s ON s.va = k.vid WHERE s.vb = j.vid AND k.pos < j.pos AND s.sim >= 0.92) AS is_near
  FROM vrows2 j),
curated AS (SELECT * FROM flags WHERE NOT is_exact AND NOT is_near)"""


def curated(spark, sf):
    """Rows that survive cleaning, the length filter and global dedup."""
    v = dedup.verdicts(documents(spark, sf))
    return v.where(F.col("keep_len") & F.col("dup_type").isNull())


@register("renumber", f"""{_CURATED_SQL}
SELECT row_number() OVER (ORDER BY pos) AS new_id, id AS original_id FROM curated""")
def renumber(spark, sf):
    """IDX-01: surviving rows renumbered 1..N in input order."""
    return splits.renumber(curated(spark, sf), "pos", bounds_from=doc_positions(spark, sf)).select(
        "new_id", F.col("id").alias("original_id"))


@register("local_id", f"""{_CURATED_SQL},
pipe AS (SELECT row_number() OVER (ORDER BY pos) AS pid, pos FROM curated)
SELECT pid - 1 AS id, pid AS original_id FROM pipe""")
def local_id(spark, sf):
    """IDX-02: local id 0..N-1, previous (pipeline) id kept as original_id."""
    bounds = doc_positions(spark, sf)
    pipe = splits.renumber(curated(spark, sf), "pos", out="pid", bounds_from=bounds)
    again = splits.renumber(pipe, "pos", out="lid", bounds_from=bounds)
    return again.select((F.col("lid") - 1).alias("id"), F.col("pid").alias("original_id"))


@register("shuffle_rank", f"""
SELECT doc_id AS id, row_number() OVER (ORDER BY {S.shuffle_key('doc_id')}, doc_id) AS shuffle_rank FROM documents""")
def shuffle_rank(spark, sf):
    """SMP-01: seeded shuffle order of all documents."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return splits.shuffle_rank(d, "id")


@register("sample_n", f"""
SELECT event_id, {S.shuffle_key('event_id')} AS shuffle_key FROM events
ORDER BY shuffle_key, event_id LIMIT 10000""")
def sample_n(spark, sf):
    """SMP-02: evaluation cap -- first 10 000 event rows of the seeded shuffle."""
    e = table(spark, sf, "events").select("event_id")
    return splits.sample_n(e, "event_id")


@register("split_stratified", f"""WITH {S.LABELLED},
{S.stratified('labelled')}
SELECT id, sentiment, split FROM split_rows""")
def split_stratified(spark, sf):
    """SPL-01: 70/15/15 stratified by sentiment over the labelled reviews."""
    lab = labelled_reviews(spark, sf).select("id", "sentiment")
    return splits.stratified_split(lab, "sentiment", "id")


@register("split_two_way", f"""WITH {S.LABELLED},
{S.stratified('labelled', validation=False)}
SELECT id, sentiment, split FROM split_rows""")
def split_two_way(spark, sf):
    """SPL-02: stratified train/test only (test 15 %)."""
    lab = labelled_reviews(spark, sf).select("id", "sentiment")
    return splits.stratified_split(lab, "sentiment", "id", validation=0)


@register("split_quotas", f"""WITH {S.LABELLED},
{S.stratified('labelled')}
SELECT c.sentiment, c.n_c, CAST(coalesce(q.t_c, 0) AS BIGINT) AS t_c, CAST(coalesce(q.v_c, 0) AS BIGINT) AS v_c
FROM cnt c LEFT JOIN quota q ON q.sentiment = c.sentiment""")
def split_quotas(spark, sf):
    """SPL-01 quota table (per class: size, test and validation counts)."""
    lab = labelled_reviews(spark, sf).select("id", "sentiment")
    return splits.stratified_quotas(lab, "sentiment")


@register("split_sequential", f"""
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {S.shuffle_key('doc_id')}, doc_id) AS rk FROM documents)
SELECT id, CASE WHEN rk <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train'
                WHEN rk <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) + CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'validation'
                ELSE 'test' END AS split
FROM r, n""")
def split_sequential(spark, sf):
    """SPL-03: unstratified 80/10/10 of all documents after the seeded shuffle."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return splits.sequential_split(d, "id")


@register("partition_labeled", f"""WITH {S.LABELLED},
n AS (SELECT count(*) AS n FROM labelled),
r AS (SELECT id, sentiment, row_number() OVER (ORDER BY {S.shuffle_key('id')}, id) AS rk FROM labelled)
SELECT id, CASE WHEN rk <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN sentiment END AS sentiment,
       rk <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS is_labeled
FROM r, n""")
def partition_labeled(spark, sf):
    """PRT-01: keep the label on the first 70 % of the shuffle, null the rest."""
    lab = labelled_reviews(spark, sf).select("id", "sentiment")
    return splits.partition_labeled(lab, "id", "sentiment")
