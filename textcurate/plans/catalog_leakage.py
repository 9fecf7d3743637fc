"""Leakage and cross-split similarity (LEK-*, DUP-08) over the stratified
splits of all reviews (texts as they are, copies included)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.operators import dedup, leakage, simjoin, splits
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import normalise, register
from textcurate.session import cut_lineage, scratch_path
from textcurate.sources.tables import UNLABELLED, attach_sentiment, documents, whole_reviews

_SPLIT_SQL = f"WITH {S.WHOLE},\n{S.stratified('whole')}"
_RANK = "list_position(['train', 'validation', 'test'], {})"
_DIM = """dim(pair, split_a, split_b) AS (VALUES ('train-validation', 'train', 'validation'),
  ('train-test', 'train', 'test'), ('validation-test', 'validation', 'test'))"""


def split_reviews(spark, sf, clean: bool = False):
    lab = whole_reviews(spark, sf).select("id", "text", "sentiment")
    if clean:
        # clean while the rows are still spread over all tasks, before the
        # split's shuffles
        lab = lab.withColumn("clean_text", T.clean_strict("text"))
    return splits.stratified_split(lab, "sentiment", "id")


def _pair_sql(key: str, measure: str) -> str:
    return f"""{_SPLIT_SQL},
d AS (SELECT DISTINCT {key}, split FROM split_rows),
p AS (SELECT a.split AS split_a, b.split AS split_b, count(*) AS {measure}
      FROM d a JOIN d b ON a.{key} = b.{key} AND {_RANK.format('a.split')} < {_RANK.format('b.split')}
      GROUP BY a.split, b.split),
{_DIM}"""


@register("leak_counts", f"""{_pair_sql('text', 'shared')}
SELECT dim.pair, CAST(coalesce(p.shared, 0) AS BIGINT) AS shared, coalesce(p.shared, 0) > 0 AS leaked
FROM dim LEFT JOIN p ON p.split_a = dim.split_a AND p.split_b = dim.split_b""")
def leak_counts(spark, sf):
    """LEK-01: distinct texts shared by each split pair + leaked verdict."""
    return leakage.leak_counts(spark, split_reviews(spark, sf))


@register("leak_detail", f"""{_SPLIT_SQL},
f AS (SELECT text, split, arg_min(sentiment, id) AS lab FROM split_rows GROUP BY text, split)
SELECT a.split || '-' || b.split AS pair, a.text, a.lab AS label_a, b.lab AS label_b
FROM f a JOIN f b ON a.text = b.text AND {_RANK.format('a.split')} < {_RANK.format('b.split')}""")
def leak_detail(spark, sf):
    """LEK-02: each shared text with the first label seen on each side."""
    return leakage.leak_detail(split_reviews(spark, sf), "text", "sentiment")


@register("leak_gate", f"""{_SPLIT_SQL},
a AS (SELECT DISTINCT text FROM split_rows WHERE split = 'train'),
b AS (SELECT DISTINCT text FROM split_rows WHERE split = 'validation'),
s AS (SELECT (SELECT count(*) FROM a JOIN b ON a.text = b.text) AS shared, (SELECT count(*) FROM b) AS nb)
SELECT CAST(shared AS BIGINT) AS shared, CAST(nb AS BIGINT) AS distinct_validation,
       {S.r('CASE WHEN nb = 0 THEN NULL ELSE shared / nb END')} AS share,
       coalesce(CASE WHEN nb = 0 THEN NULL ELSE shared / nb END < 0.01, false) AS passed FROM s""")
def leak_gate(spark, sf):
    """LEK-03: train/validation overlap share of distinct validation texts, < 1 % passes."""
    return normalise(leakage.leak_gate(split_reviews(spark, sf)))


@register("id_overlap", f"""{_pair_sql('id', 'overlap')}
SELECT dim.pair, CAST(coalesce(p.overlap, 0) AS BIGINT) AS overlap, coalesce(p.overlap, 0) = 0 AS ok
FROM dim LEFT JOIN p ON p.split_a = dim.split_a AND p.split_b = dim.split_b""")
def id_overlap(spark, sf):
    """LEK-04: ids shared between split pairs (ok when none)."""
    return leakage.id_overlap(spark, split_reviews(spark, sf))


_SIMS_SQL = f"""{_SPLIT_SQL},
cs AS (SELECT *, {S.clean_strict('text')} AS ct FROM split_rows),
cs2 AS (SELECT *, {S.dup_key('ct')} AS dup_key, true AS keep_len FROM cs),
{S.vectors('cs2')}"""
_ROW_PAIRS = f"""FROM vrows2 a JOIN sims s ON s.va = a.vid AND s.sim > 0.98
JOIN vrows2 b ON b.vid = s.vb AND {_RANK.format('a.split')} < {_RANK.format('b.split')}"""


def _similar(spark, sf):
    """Links and members. The texts are cleaned once and written as bags of words; what is
    shuffled for the splits are ids alone."""
    path = scratch_path(spark, "words")
    bagged = simjoin.vector_columns(documents(spark, sf).select("id", T.clean_strict("text").alias("clean_text")),
                                    T.clean_words(T.clean_dup_key("clean_text")))
    some = F.size("canon") > 0
    bagged = bagged.select("id", F.when(some, F.col("vid")).alias("vid"), F.when(some, F.array_join("canon", " ")).alias("terms"))
    bagged.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(bagged.schema).parquet(path)
    lab = attach_sentiment(stored.select("id", "vid"), spark, sf).withColumn("sentiment", F.coalesce("sentiment", F.lit(UNLABELLED)))
    rows = splits.stratified_split(lab, "sentiment", "id").where(F.col("vid").isNotNull())
    words = stored.where(F.col("vid").isNotNull())
    n_bytes = words.groupBy("vid").agg(F.first(F.octet_length("terms")).alias("n")).agg(F.sum("n")).first()[0] or 0
    return leakage.linked_bags(rows.select("id", "split", "vid"), words.select("vid", "terms"), dedup.CROSS_SPLIT_THRESHOLD, n_bytes)


@register("cross_split_similar", f"""{_SIMS_SQL},
nodes AS (SELECT split, vid, count(*) AS n, min(id) AS first FROM vrows2 GROUP BY split, vid)
SELECT a.split || '-' || b.split AS pair, a.vid AS vid_a, b.vid AS vid_b, {S.r('s.sim')} AS sim,
       CAST(a.n * b.n AS BIGINT) AS n_pairs, a.first AS id_a, b.first AS id_b, x.ct AS text_a, y.ct AS text_b
FROM nodes a JOIN nodes b ON {_RANK.format('a.split')} < {_RANK.format('b.split')}
JOIN sims s ON s.va = a.vid AND s.vb = b.vid JOIN cs x ON x.id = a.first JOIN cs y ON y.id = b.first WHERE s.sim > 0.98""")
def cross_split_similar(spark, sf):
    """DUP-08: near-identical texts across splits (cosine > 0.98), exact: per pair of splits
    and pair of word bags the number of row pairs and one row of either side with its text."""
    pairs = cut_lineage(leakage.representative_pairs(*_similar(spark, sf)))
    asked = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    rows = whole_reviews(spark, sf).select("id", "text").join(asked, "id", "left_semi").select("id", T.clean_strict("text").alias("clean_text"))
    return normalise(leakage.with_texts(pairs, rows, "clean_text"))


@register("cross_split_members", f"""{_SIMS_SQL}
SELECT DISTINCT r.id, r.split, r.vid FROM vrows2 r JOIN
  (SELECT a.vid AS va, b.vid AS vb {_ROW_PAIRS}) p ON r.vid = p.va OR r.vid = p.vb""")
def cross_split_members(spark, sf):
    """DUP-08: the rows of the word bags that are linked across splits."""
    return _similar(spark, sf)[1]


@register("cross_split_rows", f"""{_SIMS_SQL}
SELECT a.split || '-' || b.split AS pair, a.id AS id_a, b.id AS id_b, {S.r('s.sim')} AS sim {_ROW_PAIRS}""")
def cross_split_rows(spark, sf):
    """DUP-08: links and members joined again give every pair of similar rows."""
    return normalise(leakage.row_pairs(*_similar(spark, sf)))
