"""Duplicate detection (DUP-01..09, FLT-01/03).

Verdict of a row (DUP-03): ``exact`` if an earlier row in scope has the same
duplicate key; else ``similar`` if an earlier row in scope -- kept or not -- has
cosine >= threshold; else null. "Earlier" is the input order ``pos``.

Skew: a key or vector shared by a third of all rows is aggregated with
map-side combine (min position per key / vector), and results are joined back
on the unique row position, never on the hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.operators import rank, setjoin, simjoin
from textcurate.session import cut_lineage

# Fixed values of the duplicate detector.
NEAR_THRESHOLD = 0.92          # cosine, inclusive
CROSS_SPLIT_THRESHOLD = 0.98   # cosine, strict
BATCH_ROWS = 1000              # curation batch (input rows)
CHUNK_ROWS = 100               # comparison chunk (length-filtered rows)
# Declared two-stage detector: word-bigram Jaccard, then cosine.
TWO_STAGE_JACCARD = 0.3
TWO_STAGE_COSINE = 0.8
CHAR_GRAM_JACCARD = 0.5        # the earlier design: character 3-grams alone
# Declared domain multipliers on the near threshold; unknown -> general.
DOMAIN_MULTIPLIER = {"general": 1.0, "technology": 0.9, "service": 1.1}


def prepare(reviews: DataFrame) -> DataFrame:
    """Clean (TXT-01), count words (TXT-04), length flag (FLT-01), key (TXT-03)."""
    out = reviews.withColumn("clean_text", T.clean_strict("text"))
    out = out.withColumn("word_count", F.coalesce(F.size(T.clean_words("clean_text")).cast("long"),
                                                  F.lit(0).cast("long")))
    out = out.withColumn("keep_len", F.coalesce(T.in_length_range("word_count"), F.lit(False)))
    return out.withColumn("dup_key", T.clean_dup_key("clean_text"))


def scopes(rows: DataFrame, scope: str) -> tuple[DataFrame | None, list[str]]:
    """Scope columns per position. ``global``: none. ``windowed`` (DUP-04): batch of
    1000 input rows, then chunks of 100 length-filtered rows inside a batch.
    Batches are bounded groups, so the chunk window is bounded too. Only positions and
    length flags are ranked, once: the result is written and joined by position."""
    if scope == "global":
        return None, []
    if scope != "windowed":
        raise ValueError(f"unknown scope {scope!r}")
    bucketed = rank.range_bucket(rows.select("pos", "keep_len"), "pos", out="_pb")
    ranked = rank.row_number_exact(bucketed, [F.col("pos")], F.col("_pb"), out="_seq").drop("_pb")
    ranked = ranked.withColumn("batch", F.floor((F.col("_seq") - 1) / BATCH_ROWS).cast("long"))
    w = Window.partitionBy("batch", "keep_len").orderBy("pos")
    ranked = ranked.withColumn(
        "chunk", F.when(F.col("keep_len"),
                        F.floor((F.row_number().over(w) - 1) / CHUNK_ROWS).cast("long")))
    return cut_lineage(ranked.select("pos", "batch", "chunk")), ["batch", "chunk"]


def exact_firsts(kept: DataFrame, scope: Sequence[str], key: str = "dup_key") -> DataFrame:
    """Positions that are the first of their key in scope: a partial aggregate by the
    key's 128-bit hash, so keys are not shuffled."""
    return (kept.groupBy(*scope, F.md5(key).alias("_h")).agg(F.min("pos").alias("pos"))
            .select("pos", F.lit(True).alias("_first_key")))


def near_nodes(kept: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distinct vectors per scope with their first position and token list."""
    v = simjoin.vector_columns(kept.select("pos", *scope, "dup_key"), T.clean_words("dup_key"))
    return v.groupBy(*scope, "vid").agg(F.min("pos").alias("first_pos"),
                                        F.first("canon").alias("canon"))


def near_firsts(nodes: DataFrame, scope: Sequence[str],
                threshold_col: str | None = None, threshold: float = NEAR_THRESHOLD,
                min_threshold: float | None = None, n_bytes: int | None = None) -> DataFrame:
    """First positions of vectors that have an earlier similar vector in scope."""
    thr = min_threshold if threshold_col else threshold
    found = simjoin.earlier_similar(nodes, scope, thr, threshold_col, n_bytes=n_bytes)
    return found.select(F.col("first_pos").alias("pos"), F.lit(True).alias("_near_first"))


def verdicts(reviews: DataFrame, scope: str = "global", threshold: float = NEAR_THRESHOLD,
             near: bool = True, threshold_expr: Column | None = None,
             prepared: bool = False, checkpoint: bool = True) -> DataFrame:
    """DUP-03 cascade over ``scope``. Replaces the raw text by clean_text and
    adds word_count, keep_len, dup_key, is_exact, is_near (raw flags) and
    dup_type (null / 'exact' / 'similar'; null for length-filtered rows, which
    are never compared).

    ``threshold_expr`` (DUP-07) gives a per-row threshold from row columns; a
    pair counts when its cosine reaches the threshold of the later row.
    """
    rows = reviews if prepared else prepare(reviews).drop("text")
    if checkpoint and not prepared:
        # the cleaned rows feed four branches (output, key firsts, vector
        # nodes, postings): cut lineage once instead of re-running the regexes. The key is
        # the clean text in lower case: it is derived again, not stored beside it
        rows = cut_lineage(rows.drop("dup_key")).withColumn("dup_key", T.clean_dup_key("clean_text"))
    scoped, scope_cols = scopes(rows, scope)
    kept = rows.where("keep_len")
    if scoped is not None:
        kept = kept.join(scoped, "pos")
    # every per-position flag is gathered into one table first, so the wide
    # rows (with their text) are shuffled for a single join on the position
    flags = exact_firsts(kept, scope_cols).select(
        "pos", F.lit(1).alias("_k"), F.lit(0).alias("_v"), F.lit(0).alias("_n"))
    if near:
        nodes = near_nodes(kept, scope_cols)
        thr_col, min_thr = None, threshold
        if threshold_expr is not None:
            # the threshold of a vector as the later side is that of its first row
            first_thr = kept.select(F.col("pos").alias("first_pos"), threshold_expr.alias("thr"))
            nodes = nodes.join(first_thr, "first_pos")
            thr_col = "thr"
            min_thr = min(round(threshold * m, 9) for m in DOMAIN_MULTIPLIER.values())
        firsts = nodes.select(F.col("first_pos").alias("pos"), F.lit(0).alias("_k"),
                              F.lit(1).alias("_v"), F.lit(0).alias("_n"))
        # the size of the words without building the nodes a second time
        n_bytes = None if scope_cols or not checkpoint else simjoin.size_of("clean_text", kept)
        nf = near_firsts(nodes, scope_cols, thr_col, threshold, min_thr, n_bytes).select(
            "pos", F.lit(0).alias("_k"), F.lit(0).alias("_v"), F.lit(1).alias("_n"))
        flags = flags.unionByName(firsts).unionByName(nf)
    flags = flags.groupBy("pos").agg(F.max("_k").alias("_first_key"), F.max("_v").alias("_first_vec"),
                                     F.max("_n").alias("_near_first"))
    out = rows.join(flags if scoped is None else scoped.join(flags, "pos", "left"), "pos", "left")
    is_exact = F.col("keep_len") & (F.coalesce(F.col("_first_key"), F.lit(0)) == 0)
    if near:
        later_copy = F.coalesce(F.col("_first_vec"), F.lit(0)) == 0
        if threshold_expr is not None:
            # an identical earlier vector has cosine 1: it counts when 1 >= threshold
            later_copy = later_copy & (F.lit(1.0) >= threshold_expr)
        is_near = F.col("keep_len") & (later_copy | (F.coalesce(F.col("_near_first"), F.lit(0)) == 1))
    else:
        is_near = F.lit(False)
    res = (out.withColumn("is_exact", is_exact).withColumn("is_near", is_near)
           .withColumn("dup_type", F.when(F.col("is_exact"), "exact")
                       .when(F.col("is_near"), "similar")))
    return res.drop("_first_key", "_first_vec", "_near_first")


def set_similar(kept: DataFrame, words: Column, grams: Callable[[Column], Column] | None, threshold: float,
                cosine: float | None = None) -> DataFrame:
    """Positions of rows with an earlier row whose gram set has Jaccard >= threshold and,
    if asked, whose words have cosine >= ``cosine``. Rows with the same words are one
    node; rows without words are similar to nothing. No ``grams``: 3 characters of the words."""
    keyed = kept.select("pos", words.alias("_w")).where(F.size("_w") > 0)
    keyed = cut_lineage(keyed.withColumn("sid", F.md5(F.array_join("_w", " "))))
    nodes = keyed.groupBy("sid").agg(F.min("pos").alias("pos"), F.first("_w").alias("_w"))
    firsts = nodes.select("pos")
    if grams is None:
        texts = keyed.select(F.array_join("_w", " ").alias("_t"))
        found = setjoin.trigrams_by_blocks(nodes.select("pos", F.array_join("_w", " ").alias("text")), threshold, simjoin.size_of("_t", texts))
        return keyed.select("pos").join(firsts, "pos", "left_anti").unionByName(found)
    nodes, payload, also = nodes.withColumn("grams", grams(F.col("_w"))), [], None
    # about a gram a character at most, without building the grams a second time
    n_bytes = setjoin.GRAM_BYTES * simjoin.size_of("_t", keyed.select(F.array_join("_w", " ").alias("_t")))
    if cosine is not None:
        nodes = nodes.join(setjoin.tf_levels(nodes.select("sid", "_w"), "_w"), "sid")
        payload = ["levels", "n2"]

        def also(a: str, b: str) -> Column:
            return setjoin.level_cosine(*[F.col(f"{c}{side}") for side in (a, b) for c in payload]) >= cosine
    found = setjoin.earlier_overlap(nodes, threshold, payload=payload, also=also, n_bytes=n_bytes)
    return keyed.select("pos").join(firsts, "pos", "left_anti").unionByName(found)


def two_stage(rows: DataFrame, chars: bool = False) -> DataFrame:
    """DUP-06 on prepared rows that still have their text: ``exact`` by key, else
    ``similar`` by the words of ``similarity_words``: word-bigram Jaccard and then cosine,
    or (``chars``) character 3-gram Jaccard alone."""
    kept = rows.where("keep_len")
    words = T.similarity_words("text")
    if chars:
        near = set_similar(kept, words, None, CHAR_GRAM_JACCARD)
    else:
        near = set_similar(kept, words, setjoin.word_grams, TWO_STAGE_JACCARD, TWO_STAGE_COSINE)
    flags = exact_firsts(kept, []).select("pos", F.lit(1).alias("_k"), F.lit(0).alias("_n")).unionByName(
        near.select("pos", F.lit(0).alias("_k"), F.lit(1).alias("_n")))
    flags = flags.groupBy("pos").agg(F.max("_k").alias("_k"), F.max("_n").alias("_n"))
    out = kept.drop("text").join(flags, "pos", "left")
    return out.withColumn("dup_type", F.when(F.coalesce("_k", F.lit(0)) == 0, "exact").when(F.col("_n") == 1, "similar")).drop("_k", "_n")


def domain_threshold(domain_col: Column, threshold: float = NEAR_THRESHOLD) -> Column:
    """DUP-07: threshold x multiplier of the detector domain; unknown -> general.
    A product above 1 means that only exact copies count there. The three-entry dimension is a map literal, so no join is needed."""
    m = F.create_map(*[x for k, v in DOMAIN_MULTIPLIER.items() for x in (F.lit(k), F.lit(v))])
    return F.round(F.lit(threshold) * F.coalesce(F.element_at(m, domain_col), F.lit(1.0)), 9)


def detector_domain(source_col: Column) -> Column:
    """Fixture mapping of a document source 'src<k>' to a detector domain:
    k % 3 = 0 general, 1 technology, 2 service."""
    k = F.regexp_extract(source_col, r"(\d+)$", 1).try_cast("long") % 3
    return F.when(k == 1, "technology").when(k == 2, "service").otherwise("general")
