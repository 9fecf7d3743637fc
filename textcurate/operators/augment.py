"""Augmentation (AUG-*): row multiplication and seeded text edits.

Every random choice is a function of md5(seed ':' id ':' salt), so an edit is
reproducible per row, independent of partitioning and of task retries.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.functions.labels import hex_prefix_int
from textcurate.operators import rank
from textcurate.operators.splits import SEED, idiv, with_scalars
from textcurate.session import cut_lineage
from textcurate.sources.envelope import DOCUMENT_BREAK

# The synonym map (key -> replacements, in order) and the
# three-phrase fallback used when no phrase file is configured.
SYNONYMS = {
    "patient": ["client", "individual", "case"],
    "treatment": ["therapy", "procedure", "intervention"],
    "clinic": ["medical center", "outpatient facility"],
    "medicine": ["drug", "pharmaceutical", "medication"],
    "symptoms": ["indicators", "manifestations", "clinical signs"],
}
FALLBACK_PHRASES = [
    "though the final outcome is still unclear,",
    "but side effects can vary widely,",
    "and some doctors question its overall effectiveness,",
]
SYN_STRIP = ",.!?"
ORIG_SUFFIX = "_orig"
AUG_SUFFIX = "_aug"


def phrase_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """SRC-05: the phrase dimension (idx 0..n-1, phrase), read by Spark from JSON files
    {"ambiguous_phrases": [...]}, one or several to a file, on one line each or not. idx is the exact rank by the phrase's
    hash (K-RANK), so it depends neither on files nor on tasks; a phrase listed twice has
    two numbers. A missing file gives the three fallback phrases; a file without phrases
    gives none, and then texts stay as they are."""
    listed = None
    if path is not None:
        try:
            text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", DOCUMENT_BREAK)).alias("value"))
            listed = text.select(F.explode(F.from_json("value", "ambiguous_phrases array<string>")["ambiguous_phrases"]).alias("phrase"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if listed is None:
        return spark.createDataFrame(list(enumerate(FALLBACK_PHRASES)), "idx long, phrase string")
    hashed = listed.where("phrase is not null").select("phrase", F.md5("phrase").alias("_h"))
    ranked = rank.row_number_exact(hashed, [F.col("_h"), F.col("phrase")], rank.hex_bucket(F.col("_h")), out="idx")
    return cut_lineage(ranked.select((F.col("idx") - 1).alias("idx"), "phrase"))


def choice(seed, key: Column, salt: str, n) -> Column:
    """Seeded index in [0, n) from md5(seed ':' key ':' salt)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{salt}")))
    return F.pmod(hex_prefix_int(h, 8), n)


def synonym_key(tok: Column) -> Column:
    """Lower-cased token with ,.!? stripped from both ends (Python strip)."""
    return F.btrim(F.lower(tok), F.lit(SYN_STRIP))


def _synonym_words(words: Column, key: Column, seed: int) -> Column:
    """Token list after synonym replacement, re-split into words (a synonym
    may have two words)."""
    m = F.create_map(*[x for k, v in SYNONYMS.items()
                       for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])

    def sub(t, i):
        options = F.element_at(m, synonym_key(t))
        pick = choice(seed, F.concat(key.cast("string"), F.lit(":"), i.cast("string")), "syn",
                      F.size(options))
        return F.when(options.isNull(), F.array(t)).otherwise(
            F.split(F.element_at(options, (pick + 1).cast("int")), " "))

    return F.flatten(F.transform(words, sub))


def with_phrase(df: DataFrame, key: str, phrases: DataFrame, seed: int = SEED, out: str = "_phrase") -> DataFrame:
    """Each row with its seeded phrase: an equi-join on the phrase's number. Rows are spread
    evenly over the numbers; a small dimension is broadcast by its size at runtime. Without phrases it is null."""
    n = phrases.agg(F.count(F.lit(1)).alias("_n_phrases"))
    pick = F.when(F.col("_n_phrases") > 0, choice(seed, F.col(key), "phrase", F.greatest("_n_phrases", F.lit(1))))
    picked = with_scalars(df, n).withColumn("_idx", pick).drop("_n_phrases")
    return picked.join(phrases.select(F.col("idx").alias("_idx"), F.col("phrase").alias(out)), "_idx", "left").drop("_idx")


def _inject_words(words: Column, key: Column, phrase: Column, seed: int) -> Column:
    """Insert the phrase at a seeded position 0..len of the word list; null inserts nothing."""
    pos = choice(seed, key, "pos", F.size(words) + 1).cast("int")
    return F.when(phrase.isNull(), words).otherwise(F.array_insert(words, pos + 1, phrase))


def replace_synonyms(text: Column, key: Column, seed: int = SEED) -> Column:
    """AUG-01: whole tokens whose lower-cased, ,.!?-stripped form is a key are
    replaced by a seeded choice of its synonyms (punctuation and case lost)."""
    return F.array_join(_synonym_words(T.words(text), key, seed), " ")


def inject_phrase(text: Column, key: Column, phrase: Column, seed: int = SEED) -> Column:
    """AUG-02: insert the phrase (see ``with_phrase``) at a seeded position 0..len (inclusive)."""
    return F.array_join(_inject_words(T.words(text), key, phrase, seed), " ")


def augment_text(text: Column, key: Column, phrase: Column, seed: int = SEED) -> Column:
    """AUG-03: synonyms, then the injected phrase (one word split in total)."""
    return F.array_join(_inject_words(_synonym_words(T.words(text), key, seed), key, phrase, seed), " ")


def augmented_rows(df: DataFrame, id_col: str, text: str, label: str,
                   phrases: DataFrame, seed: int = SEED) -> DataFrame:
    """AUG-04: each row -> '<id>_orig' (text as is) and '<id>_aug' (augmented),
    same label. A narrow explode after the phrase join."""
    df = with_phrase(df.select(id_col, text, label), id_col, phrases, seed)
    aug = augment_text(F.col(text), F.col(id_col), F.col("_phrase"), seed)
    pair = F.array(
        F.struct(F.concat(F.col(id_col).cast("string"), F.lit(ORIG_SUFFIX)).alias("id"),
                 F.col(text).alias("text"), F.col(id_col).alias("source_id")),
        F.struct(F.concat(F.col(id_col).cast("string"), F.lit(AUG_SUFFIX)).alias("id"),
                 aug.alias("text"), F.col(id_col).alias("source_id")))
    return df.select(F.explode(pair).alias("_r"), F.col(label)).select("_r.*", label)


def mixed_ratio(real: DataFrame, synthetic: DataFrame, id_col: str,
                synthetic_share: Fraction = Fraction(3, 10), seed: int = SEED) -> DataFrame:
    """MET-18 (declared stub, finished): add synthetic rows to the real ones so
    that they make up ``synthetic_share`` of the result -- floor(n_real * r / (1 - r))
    synthetic rows, chosen in seeded hash order (K-RANK), all real rows kept."""
    r = synthetic_share
    p, q = (r / (1 - r)).numerator, (r / (1 - r)).denominator
    n_real = real.agg(F.count(F.lit(1)).alias("_n"))
    target = n_real.select(idiv(F.col("_n") * p, F.lit(q)).alias("_target"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    ranked = rank.row_number_exact(synthetic.withColumn("_h", key), [F.col("_h"), F.col(id_col)],
                                   rank.hex_bucket(F.col("_h")), [], "_rk")
    chosen = with_scalars(ranked, target).where(F.col("_rk") <= F.col("_target")) \
        .drop("_rk", "_target", "_h")
    return real.withColumn("origin", F.lit("real")).unionByName(
        chosen.withColumn("origin", F.lit("synthetic")))
