"""Augmentation queries (AUG-01..04, MET-18) over all reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcurate.operators import augment as A
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import register
from textcurate.session import scratch_path
from textcurate.sources.tables import table, whole_reviews

_STRIP = "[,.!?]"


def _h(key_sql: str, salt: str) -> str:
    return f"('0x' || substr(md5('42:' || {key_sql} || ':{salt}'), 1, 8))::UBIGINT"


# Fixed values, stated apart from the operator's: the synonyms and the fallback phrases.
_SYNONYMS = {"patient": ["client", "individual", "case"], "treatment": ["therapy", "procedure", "intervention"],
             "clinic": ["medical center", "outpatient facility"], "medicine": ["drug", "pharmaceutical", "medication"],
             "symptoms": ["indicators", "manifestations", "clinical signs"]}
_FALLBACK = ["though the final outcome is still unclear,", "but side effects can vary widely,", "and some doctors question its overall effectiveness,"]


def _syn_sql(text: str, idc: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in _SYNONYMS.items())
    opts = f"(CASE regexp_replace(lower(t), '^{_STRIP}+|{_STRIP}+$', '', 'g') {cases} END)"
    pick = _h(f"CAST({idc} AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)", "syn")
    return (f"array_to_string(list_transform({S.words(text)}, lambda t, i: "
            f"CASE WHEN {opts} IS NULL THEN t ELSE {opts}[CAST({pick} % len({opts}) AS BIGINT) + 1] END), ' ')")


def _inject_sql(text: str, idc: str) -> str:
    """With the list of phrases in a relation ph(phrases)."""
    w = S.words(text)
    pos = f"CAST({_h(f'CAST({idc} AS VARCHAR)', 'pos')} % (len(ws) + 1) AS BIGINT)"
    ph = f"(SELECT phrases[CAST({_h(f'CAST({idc} AS VARCHAR)', 'phrase')} % len(phrases) AS BIGINT) + 1] FROM ph)"
    return (f"(SELECT array_to_string(list_concat(list_concat(ws[1:{pos}], [{ph}]), ws[{pos} + 1:]), ' ') "
            f"FROM (SELECT {w} AS ws))")


def _aug_sql(text: str, idc: str) -> str:
    return _inject_sql(f"({_syn_sql(text, idc)})", idc)


_PHRASE = "array_to_string(list_slice(string_split({t}, ' '), 1, 4), ' ')"
_ALL = f"""WITH {S.WHOLE},
ph AS MATERIALIZED (SELECT list(p ORDER BY md5(p), p) AS phrases FROM (SELECT DISTINCT {_PHRASE.format(t='text')} AS p FROM documents) WHERE p <> '')"""
_THREE = f"""WITH {S.WHOLE}, ph AS (SELECT {_FALLBACK} AS phrases)"""


def _phrases(spark, sf):
    """A phrase file made of the first words of all documents, read as the phrase dimension."""
    path = scratch_path(spark, "phrases")
    first = F.array_join(F.slice(F.split("text", " ", -1), 1, 4), " ")
    listed = table(spark, sf, "documents").select(first.alias("p")).where("p <> ''").distinct()
    # files of bounded size: some 65 536 phrases at most in each
    files = listed.groupBy(F.pmod(F.xxhash64("p"), F.lit(16)).alias("k")).agg(F.collect_list("p").alias("ambiguous_phrases"))
    files.repartition(16, "k").select("ambiguous_phrases").write.json(path)
    return A.phrase_table(spark, path)


def _spoken(text):
    """Texts in which some frequent words read like the keys of the synonym map."""
    return F.replace(F.replace(text, F.lit(" the "), F.lit(" Patient, ")), F.lit(" la "), F.lit(" medicine "))


_SPOKEN = "replace(replace(text, ' the ', ' Patient, '), ' la ', ' medicine ')"


@register("aug_synonym", f"""WITH {S.WHOLE}, spoken AS (SELECT id, {_SPOKEN} AS text FROM whole)
SELECT id, {_syn_sql('text', 'id')} AS text FROM spoken""")
def aug_synonym(spark, sf):
    """AUG-01: seeded synonym replacement of whole tokens (five keys, of which two are
    put into the documents' texts here)."""
    return whole_reviews(spark, sf).select("id", A.replace_synonyms(_spoken(F.col("text")), F.col("id")).alias("text"))


@register("aug_inject", f"""{_ALL}
SELECT id, {_inject_sql('text', 'id')} AS text FROM whole""")
def aug_inject(spark, sf):
    """AUG-02 with SRC-05: one phrase of a phrase file inserted at a seeded position 0..len."""
    rows = A.with_phrase(whole_reviews(spark, sf), "id", _phrases(spark, sf))
    return rows.select("id", A.inject_phrase(F.col("text"), F.col("id"), F.col("_phrase")).alias("text"))


@register("aug_full", f"""{_THREE}, spoken AS (SELECT id, {_SPOKEN} AS text FROM whole)
SELECT id, {_aug_sql('text', 'id')} AS text FROM spoken""")
def aug_full(spark, sf):
    """AUG-03: synonyms, then injection of one of the fallback phrases."""
    rows = A.with_phrase(whole_reviews(spark, sf).withColumn("text", _spoken(F.col("text"))), "id", A.phrase_table(spark))
    return rows.select("id", A.augment_text(F.col("text"), F.col("id"), F.col("_phrase")).alias("text"))


_ROWS_SQL = f"""{_THREE},
aug AS (
  SELECT CAST(id AS VARCHAR) || '_orig' AS id, text, id AS source_id, sentiment FROM whole
  UNION ALL
  SELECT CAST(id AS VARCHAR) || '_aug', {_aug_sql('text', 'id')}, id, sentiment FROM whole)"""


@register("aug_rows", f"""{_ROWS_SQL}
SELECT * FROM aug""")
def aug_rows(spark, sf):
    """AUG-04: every row as '<id>_orig' plus its '<id>_aug' variant."""
    return A.augmented_rows(whole_reviews(spark, sf), "id", "text", "sentiment", A.phrase_table(spark))


@register("mixed_ratio", f"""{_ROWS_SQL},
n AS (SELECT count(*) * 3 // 7 AS target FROM whole),
syn AS (SELECT id, text, sentiment, row_number() OVER (ORDER BY md5('42:' || id), id) AS rk FROM aug WHERE id LIKE '%_aug')
SELECT CAST(id AS VARCHAR) AS id, text, sentiment, 'real' AS origin FROM whole
UNION ALL
SELECT id, text, sentiment, 'synthetic' FROM syn, n WHERE rk <= target""")
def mixed_ratio(spark, sf):
    """MET-18: real reviews plus seeded synthetic variants making up 30 %."""
    whole = whole_reviews(spark, sf)
    rows = A.augmented_rows(whole, "id", "text", "sentiment", A.phrase_table(spark))
    syn = rows.where(F.col("id").endswith(A.AUG_SUFFIX)).select("id", "text", "sentiment")
    real = whole.select(F.col("id").cast("string").alias("id"), "text", "sentiment")
    return A.mixed_ratio(real, syn, "id")
