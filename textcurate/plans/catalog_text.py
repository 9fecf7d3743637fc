"""Projections, scalar text/label functions and filters (TXT-*, FLT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.functions import labels as L
from textcurate.functions import text as T
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import normalise, register
from textcurate.sources.tables import documents, sentiment_of, table


def _clean_docs(spark, sf):
    return documents(spark, sf).select("id", T.clean_strict("text").alias("clean_text"))


@register("clean_strict", f"""
SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents""")
def clean_strict(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), T.clean_strict("text").alias("clean_text"))


@register("clean_permissive", f"""
SELECT 'documents' AS tbl, doc_id AS id, CAST(0 AS BIGINT) AS sub, {S.clean_permissive('text')} AS clean_text FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, {S.clean_permissive('text')} FROM conversations
UNION ALL
SELECT 'pages', page_id, CAST(0 AS BIGINT), {S.clean_permissive('html')} FROM pages""")
def clean_permissive(spark, sf):
    d = table(spark, sf, "documents").select(
        F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"),
        F.lit(0).cast("long").alias("sub"), T.clean_permissive("text").alias("clean_text"))
    c = table(spark, sf, "conversations").select(
        F.lit("conversations"), F.col("conv_id"), F.col("turn").cast("long"),
        T.clean_permissive("text"))
    p = table(spark, sf, "pages").select(
        F.lit("pages"), F.col("page_id"), F.lit(0).cast("long"), T.clean_permissive("html"))
    return d.unionAll(c).unionAll(p)


@register("dup_key", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents)
SELECT id, {S.dup_key('clean_text')} AS dup_key FROM c""")
def dup_key(spark, sf):
    return _clean_docs(spark, sf).select("id", T.dup_key("clean_text").alias("dup_key"))


@register("word_count", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents)
SELECT id, {S.word_count('clean_text')} AS word_count FROM c""")
def word_count(spark, sf):
    return _clean_docs(spark, sf).select(
        "id", F.size(T.clean_words("clean_text")).cast("long").alias("word_count"))


@register("length_filter", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
w AS (SELECT id, clean_text, {S.word_count('clean_text')} AS word_count FROM c)
SELECT id, clean_text, word_count FROM w WHERE word_count BETWEEN 5 AND 150""")
def length_filter(spark, sf):
    c = _clean_docs(spark, sf).withColumn("word_count", T.word_count("clean_text"))
    return c.where(T.in_length_range("word_count"))


@register("removed_filter", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
f AS (SELECT id, clean_text, NOT ({S.word_count('clean_text')} BETWEEN 5 AND 150) AS is_removed FROM c)
SELECT id, clean_text FROM f WHERE NOT coalesce(is_removed, false)""")
def removed_filter(spark, sf):
    """FLT-02: drop rows flagged is_removed (the flag here: outside length bounds)."""
    c = _clean_docs(spark, sf).withColumn(
        "is_removed", ~T.in_length_range(T.word_count("clean_text")))
    return c.where(~F.coalesce(F.col("is_removed"), F.lit(False))).select("id", "clean_text")


_SENT_LENS = (f"list_transform(list_filter(string_split(clean_text, '.'), "
              f"lambda s: {S.collapse_ws('s')} <> ''), lambda s: len({S.words('s')}))")


@register("vocab_richness", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
w AS (SELECT id, {S.words('lower(clean_text)')} AS ws FROM c)
SELECT id, {S.r("CASE WHEN len(ws) = 0 THEN 0.0 ELSE CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws) END")} AS vocab_richness FROM w""")
def vocab_richness(spark, sf):
    return normalise(_clean_docs(spark, sf).select(
        "id", T.vocab_richness("clean_text", clean=True).alias("vocab_richness")))


@register("text_complexity", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
s AS (SELECT id, {S.words('lower(clean_text)')} AS ws, {_SENT_LENS} AS lens FROM c),
m AS (SELECT id, ws, CAST(len(lens) AS DOUBLE) AS n,
             CAST(coalesce(list_sum(lens), 0) AS DOUBLE) AS tot,
             CAST(coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) AS DOUBLE) AS sq FROM s)
SELECT id,
  {S.r("CASE WHEN len(ws) = 0 THEN 0.0 ELSE CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws) END")} AS vocab_richness,
  {S.r("CASE WHEN n = 0 THEN 0.0 ELSE tot / n END")} AS avg_sentence_length,
  {S.r("CASE WHEN n = 0 THEN 0.0 ELSE sqrt(greatest((n * sq - tot * tot) / (n * n), 0.0)) END")} AS sentence_length_variation
FROM m""")
def text_complexity(spark, sf):
    rich, avg, std = T.text_complexity(F.col("clean_text"), clean=True)
    return normalise(_clean_docs(spark, sf).select(
        "id", rich.alias("vocab_richness"), avg.alias("avg_sentence_length"),
        std.alias("sentence_length_variation")))


_FLESCH = """CASE WHEN nw = 0 THEN 0.0 ELSE 206.835 - 1.015 * (nw / ns) - 84.6 * (nsyl / nw) END"""


@register("quality_gate", f"""
WITH c AS (SELECT doc_id AS id, {S.clean_strict('text')} AS clean_text FROM documents),
s AS (SELECT id, clean_text, {S.words('clean_text')} AS w, {S.words('lower(clean_text)')} AS lw,
             {_SENT_LENS} AS lens FROM c),
g AS (SELECT id, unnest(CASE WHEN len(lw) >= 3 THEN list_transform(range(1, len(lw) - 1),
              lambda i: array_to_string(lw[i:i + 2], ' ')) ELSE [] END) AS gram FROM s),
gc AS (SELECT id, max(cnt) AS rep FROM (SELECT id, gram, count(*) AS cnt FROM g GROUP BY id, gram) GROUP BY id),
m AS (SELECT s.id, CAST(len(w) AS DOUBLE) AS nw, CAST(greatest(len(lens), 1) AS DOUBLE) AS ns,
             CAST(coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '([aeiouy]+)', 1)), 1))), 0) AS DOUBLE) AS nsyl,
             len(w) AS n_words, len(lens) AS n_sent,
             CASE WHEN len(lw) = 0 THEN 0.0 ELSE CAST(len(list_distinct(lw)) AS DOUBLE) / len(lw) END AS uniq,
             coalesce(gc.rep, 0) AS rep
      FROM s LEFT JOIN gc ON gc.id = s.id)
SELECT id, CAST(n_words AS BIGINT) AS n_words, CAST(n_sent AS BIGINT) AS n_sentences,
       {S.r(_FLESCH)} AS flesch, {S.r('uniq')} AS unique_ratio, CAST(rep AS BIGINT) AS max_repeat,
       (n_words BETWEEN 10 AND 200) AND (n_sent BETWEEN 2 AND 20) AND ({_FLESCH}) >= 60
         AND uniq >= 0.7 AND rep <= 2 AS passed
FROM m""")
def quality_gate(spark, sf):
    """TXT-13 (declared gate, finished): words 10-200, sentences 2-20, Flesch >= 60,
    unique-word ratio >= 0.7, no word 3-gram more than twice."""
    c = _clean_docs(spark, sf).withColumn("_lw", T.clean_words(F.lower(F.col("clean_text"))))
    n_words = F.size("_lw")
    n_sent = F.size(T.sentence_lengths(F.col("clean_text"), clean=True))
    flesch = T.flesch_reading_ease(F.col("clean_text"), clean=True)
    uniq = T.vocab_richness("clean_text", clean=True)
    rep = T.max_trigram_repeat(F.col("_lw"))
    out = c.select("id", n_words.cast("long").alias("n_words"), n_sent.cast("long").alias("n_sentences"),
                   flesch.alias("flesch"), uniq.alias("unique_ratio"), rep.cast("long").alias("max_repeat"))
    passed = (F.col("n_words").between(10, 200) & F.col("n_sentences").between(2, 20)
              & (F.col("flesch") >= 60) & (F.col("unique_ratio") >= 0.7) & (F.col("max_repeat") <= 2))
    return normalise(out.withColumn("passed", passed))


_LABELLED_SQL = f"""lab AS (SELECT l.doc_id AS id, {S.sentiment('l.quality', 'l.toxic')} AS sentiment FROM labels l)"""


@register("label_encode", f"""
WITH {_LABELLED_SQL}
SELECT id, sentiment, CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS BIGINT) AS label FROM lab""")
def label_encode(spark, sf):
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        sentiment_of(F.col("quality"), F.col("toxic")).alias("sentiment"))
    code = L.encode_label("sentiment")
    # strict: an unknown label fails the job instead of passing silently
    checked = F.when(code.isNull(), F.raise_error(F.lit("unknown sentiment label"))).otherwise(code)
    return lab.select("id", "sentiment", checked.cast("long").alias("label"))


@register("collapse5_stars", """
SELECT vec_id AS row_id, CAST(label % 5 AS BIGINT) AS pred5,
  CAST(CASE WHEN label % 5 = 0 THEN 0 WHEN label % 5 = 4 THEN 2 ELSE 1 END AS BIGINT) AS pred3
FROM embeddings""")
def collapse5_stars(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"),
                                               (F.col("label") % 5).cast("long").alias("pred5"))
    return e.withColumn("pred3", L.collapse5_stars("pred5").cast("long"))


@register("collapse5_polarity", """
SELECT vec_id AS row_id, CAST(label % 5 AS BIGINT) AS pred5,
  CAST(CASE WHEN label % 5 IN (0, 1) THEN 0 WHEN label % 5 = 2 THEN 1 ELSE 2 END AS BIGINT) AS pred3
FROM embeddings""")
def collapse5_polarity(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"),
                                               (F.col("label") % 5).cast("long").alias("pred5"))
    return e.withColumn("pred3", L.collapse5_polarity("pred5").cast("long"))


@register("argmax", """
SELECT vec_id AS row_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax
FROM embeddings""")
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), L.argmax("embedding").alias("argmax"))


# Classifier-style label strings cycled over rows for TXT-11.
RAW_LABELS = ["POSITIVE", "NEGATIVE", "LABEL_2", "neg", "Pos"]


@register("polarity_norm", """
WITH r AS (SELECT vec_id AS row_id, ['POSITIVE', 'NEGATIVE', 'LABEL_2', 'neg', 'Pos'][vec_id % 5 + 1] AS raw_label FROM embeddings)
SELECT row_id, raw_label,
  CASE WHEN upper(raw_label) LIKE '%POS%' THEN 'positive' WHEN upper(raw_label) LIKE '%NEG%' THEN 'negative' ELSE 'neutral' END AS sentiment
FROM r""")
def polarity_norm(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW_LABELS]), (F.col("vec_id") % 5 + 1).cast("int"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), raw.alias("raw_label"))
    return e.withColumn("sentiment", L.polarity_norm("raw_label"))
