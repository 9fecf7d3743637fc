"""K-SIM: exact cosine similarity join on bag-of-words vectors by prefix filtering.

Vectors are term-frequency bags of whitespace tokens, compared by cosine.
Identical bags are collapsed first (a vector id is the md5 of the sorted token
list), so copies of one text cost one node, however many there are.

Candidate generation (exact, no cross join): order every vector's tokens by
ascending global document frequency, then token. Keep a token in the vector's
*prefix* while the norm of the remaining suffix (this token included) is at
least the threshold t. If cos(x, y) >= t the two prefixes share a token
(Cauchy-Schwarz on the suffix after the earlier prefix end), so joining prefix
postings on token finds every qualifying pair. Candidates are verified with an
exact integer dot product of the two sparse term-frequency vectors.

Postings serve comparisons inside scopes. Over a whole table the pairs that they make grow
with the square of a token's frequency, so there vectors meet by blocks (``blockjoin``),
exactly too.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.operators import blockjoin
from textcurate.session import cut_lineage

# Similarities are rounded to this many decimals before any threshold test, in
# every engine, so that threshold decisions do not depend on summation order.
SIM_DECIMALS = 9
# The prefix bound is loosened by this much: rounding can lift a similarity
# just below t onto t, and those pairs must still become candidates.
PREFIX_SLACK = 1e-6


def canonical_tokens(tokens: Column) -> Column:
    """Sorted token list: equal for equal bags, whatever the word order. (array_sort calls a
    comparator for every two tokens, at several times the cost.)"""
    return F.sort_array(tokens)


def vector_id(tokens: Column) -> Column:
    """md5 of the sorted token list (128 bits: collisions are negligible)."""
    return F.md5(F.array_join(canonical_tokens(tokens), " "))


def term_frequencies(vec: DataFrame) -> DataFrame:
    """(vid, word, tf) of sorted token lists: their runs are counted in place, so postings
    are not shuffled to be counted."""
    begins = vec.select("vid", "canon", F.expr("filter(sequence(0, size(canon)), i -> i = 0 OR i = size(canon) OR canon[i] <> canon[i - 1])").alias("b"))
    runs = begins.select("vid", F.expr("transform(slice(b, 1, size(b) - 1), (x, i) -> struct(canon[x] AS word, CAST(b[i + 1] - x AS BIGINT) AS tf))").alias("r"))
    return runs.select("vid", F.inline("r"))


# A signature sets one of this many bits for each token of a vector.
SIGNATURE_WORDS = 8  # longs, 512 bits
SIGNATURE = [f"s{k}" for k in range(SIGNATURE_WORDS)]


def with_signature(vecs: DataFrame) -> DataFrame:
    """``vecs`` with the signature of their tokens, in longs ``s0``, ``s1``, ... A bit that
    x has and y lacks stands for a token of x that is not in y."""
    hashed = vecs.withColumn("_h", F.expr("transform(flatten(levels.t), x -> xxhash64(x))"))
    return hashed.select(*vecs.columns, *[F.expr(
        f"aggregate(_h, 0L, (s, x) -> IF(((x >> 6) & {SIGNATURE_WORDS - 1}) = {k}, s | shiftleft(1L, CAST(x & 63 AS INT)), s))").alias(c)
        for k, c in enumerate(SIGNATURE)])


def vector_table(nodes: DataFrame, threshold: float) -> DataFrame:
    """One row per distinct vector: (vid, levels, large, n2, l1, mx, prefix).

    ``levels`` is the term-frequency vector, its tokens by frequency, ``large`` the level
    of most tokens; ``n2`` the squared
    norm, ``l1``/``mx`` the sum and largest term frequency (for the length bound) and
    ``prefix`` the vector's prefix tokens for cosine >= threshold, each with the share of
    the squared norm that it and what follows have; and ``SIGNATURE``. Tokens are numbers of a
    written dictionary, so texts are not shuffled further. Term and document
    frequencies are partial aggregates (a hot token combines on the map side); the rest is work on one document's vocabulary, in one shuffle by vector.
    """
    vec = nodes.select("vid", "canon").dropDuplicates(["vid"])
    post = term_frequencies(vec)
    dfreq = post.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("dfreq"))
    # numbers are drawn once and kept: a retried task must not draw them again
    numbered = cut_lineage(dfreq.withColumn("token", F.monotonically_increasing_id()))
    # suffix norm of each token in (dfreq, token) order: a window over one
    # vector's distinct tokens (bounded by one document's vocabulary)
    t = max(threshold - PREFIX_SLACK, 0.0)
    w_suffix = (Window.partitionBy("vid").orderBy("dfreq", "token")
                .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w_vec = Window.partitionBy("vid")
    sq = F.col("tf") * F.col("tf")
    staged = post.join(numbered, "word").select(
        "vid", "token", "tf", F.sum(sq).over(w_suffix).alias("suffix2"),
        F.sum(sq).over(w_vec).alias("n2"))
    in_prefix = F.col("suffix2").cast("double") >= F.lit(t * t) * F.col("n2").cast("double")
    level = staged.groupBy("vid", "tf").agg(
        F.first("n2").cast("long").alias("n2"), F.collect_list("token").alias("t"),
        F.collect_list(F.when(in_prefix, F.struct("token", (F.col("suffix2") / F.col("n2")).alias("rest")))).alias("p"))
    return with_signature(level.groupBy("vid").agg(
        F.first("n2").alias("n2"), F.sum(F.col("tf") * F.size("t")).cast("long").alias("l1"),
        F.max("tf").cast("long").alias("mx"), F.collect_list(F.struct("tf", "t")).alias("levels"),
        F.max_by(F.struct("tf", "t"), F.struct(F.size("t"), "tf")).alias("large"),
        F.flatten(F.collect_list("p")).alias("prefix")))


def level_dot(levels_a: Column, levels_b: Column) -> Column:
    """Exact dot product of two term-frequency vectors given by levels: over pairs of
    levels, frequency times frequency times the tokens in both. A text of L words
    has fewer than sqrt(2 L) levels, most have a few."""
    zero = F.lit(0).cast("long")
    return F.aggregate(levels_a, zero, lambda s, x: s + F.aggregate(
        levels_b, zero, lambda r, y: r + x["tf"] * y["tf"] * F.size(F.array_intersect(x["t"], y["t"]))))


def sim_expr(dot: Column, n2_a: Column, n2_b: Column) -> Column:
    # as doubles: the product of two squared norms can exceed 64 bits
    return F.round(dot.cast("double") / F.sqrt(n2_a.cast("double") * n2_b.cast("double")), SIM_DECIMALS)


def _prefix_postings(nodes: DataFrame, vecs: DataFrame, cols: list[str]) -> DataFrame:
    return nodes.select(*cols, "vid").join(
        vecs.select("vid", "n2", "l1", "mx", *SIGNATURE, F.explode("prefix").alias("_p")), "vid").select(
            *cols, "vid", "n2", "l1", "mx", *SIGNATURE, "_p.token", "_p.rest")


BOUNDS = ["n2", "l1", "mx", "rest", *SIGNATURE]  # columns of a posting that the bounds look at


def _bounded(a: str, b: str, least: float) -> Column:
    """Whether a posting pair can belong to vectors of cosine >= ``least``: by length,
    x.y <= min(|x|_1 max(y), |y|_1 max(x)); and, at the first token that both prefixes hold,
    by what is left from it on (Cauchy-Schwarz). Later shared tokens may fail the second
    test, the first one passes it for every pair that qualifies. And by signatures: tokens
    that the other vector lacks count 1 each at least, so cos^2 <= (1 - u / |x|^2) (1 - v / |y|^2)
    if x has u bits that y lacks, and y v bits that x lacks."""
    d = lambda c: F.col(c).cast("double")

    def own(x: str, y: str) -> Column:  # squared norm less the tokens that y is known to lack
        lacks = [F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}{c}")))) for c in SIGNATURE]
        return d(f"{x}n2") - functools.reduce(operator.add, lacks).cast("double")

    length = F.least(d(f"{a}l1") * d(f"{b}mx"), d(f"{b}l1") * d(f"{a}mx")) / F.sqrt(d(f"{a}n2") * d(f"{b}n2"))
    return ((length >= F.lit(least)) & (d(f"{a}rest") * d(f"{b}rest") >= F.lit(least * least))
            & (own(a, b) * own(b, a) >= F.lit(least * least) * d(f"{a}n2") * d(f"{b}n2")))


def verify(vecs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (with vid_a, vid_b) and their exact cosine, ``sim``, where it can reach the
    threshold; else 0. If tokens of x that y lacks have more than 1 - t * t of x's squared
    norm, the cosine is below t; this is tested on one level first, with one intersection."""
    least = max(threshold - PREFIX_SLACK, 0.0)

    def sided(s: str) -> DataFrame:
        return vecs.select(*[F.col(c).alias(f"{c}_{s}") for c in ("vid", "levels", "large", "n2")])

    def enough(x: str, y: str) -> Column:
        lacks = F.size(f"large_{x}.t") - F.size(F.array_intersect(F.col(f"large_{x}.t"), F.flatten(F.col(f"levels_{y}.t"))))
        return F.col(f"large_{x}.tf") * F.col(f"large_{x}.tf") * lacks <= F.lit(1.0 - least * least) * F.col(f"n2_{x}")

    sim = sim_expr(level_dot(F.col("levels_a"), F.col("levels_b")), F.col("n2_a"), F.col("n2_b"))
    sim = F.when(enough("a", "b") & enough("b", "a"), sim).otherwise(F.lit(0.0))
    return pairs.join(sided("a"), "vid_a").join(sided("b"), "vid_b").select(*pairs.columns, sim.alias("sim"))


def size_of(column: str, rows: DataFrame) -> int:
    """Bytes of a text column."""
    return rows.agg(F.sum(F.octet_length(column))).first()[0] or 0


def similar_vectors(vecs: DataFrame, threshold: float, strict: bool = False, n_bytes: int | None = None) -> DataFrame:
    """(vid_a, vid_b, sim), vid_a < vid_b, of vectors (``vid``, unique, and ``canon``) with cosine
    >= threshold (> if strict)."""
    words = vecs.where(F.size("canon") > 0).select("vid", F.array_join("canon", " ").alias("terms"))
    return similar_texts(words, threshold, strict, size_of("terms", words) if n_bytes is None else n_bytes)


def similar_texts(words: DataFrame, threshold: float, strict: bool, n_bytes: int) -> DataFrame:
    """``similar_vectors`` of ``vid`` and ``terms`` (words joined by spaces), ``n_bytes`` of them in all."""
    near = blockjoin.similar_bags(words.withColumnRenamed("vid", "key"), n_bytes, threshold)
    sim = sim_expr(F.col("dot"), F.col("n2_a"), F.col("n2_b"))
    pairs = near.select(F.least("key_a", "key_b").alias("vid_a"), F.greatest("key_a", "key_b").alias("vid_b"), sim.alias("sim"))
    return pairs.where(F.col("sim") > threshold if strict else F.col("sim") >= threshold)


def similar_pairs(nodes: DataFrame, node_cols: Sequence[str], threshold: float,
                  strict: bool = False, on: Sequence[str] = (), condition=None,
                  prefix_threshold: float | None = None, materialise: bool = True) -> DataFrame:
    """All node pairs with cosine >= threshold (> if strict).

    ``nodes`` has ``vid``, ``canon`` (sorted token list) and ``node_cols``;
    several nodes may share a vector. ``on`` lists node columns that must be
    equal on both sides (a dedup scope); ``condition`` filters pairs and is
    written on suffixed names (``first_pos_a < first_pos_b``). Returns
    ``<col>_a``, ``vid_a``, ``<col>_b``, ``vid_b``, ``sim``.

    Without ``on``, the distinct vectors meet by blocks. Else candidates come
    from a self-join of prefix postings on token (no cross join), then each
    distinct vector pair is verified exactly. This lists every qualifying pair,
    which is the output itself; for "does an earlier similar node exist" use
    ``earlier_similar``, which bounds the work on dense clusters.
    """
    cols = list(dict.fromkeys(list(on) + list(node_cols)))
    if materialise:
        nodes = cut_lineage(nodes.select(*cols, "vid", "canon"))
    if not on:
        links = similar_vectors(nodes.select("vid", "canon").dropDuplicates(["vid"]), threshold, strict)
        own = nodes.where(F.size("canon") > 0).select(F.col("vid").alias("vid_a"), F.col("vid").alias("vid_b"), F.lit(1.0).alias("sim")).distinct()
        own = own.where(F.col("sim") > threshold if strict else F.col("sim") >= threshold)
        ways = F.array(F.struct("vid_a", "vid_b"), F.struct(F.col("vid_b").alias("vid_a"), F.col("vid_a").alias("vid_b")))
        links = links.select(F.explode(ways).alias("w"), "sim").select("w.*", "sim").unionByName(own)
        side = lambda x: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in [*cols, "vid"]]).dropDuplicates()
        j = links.join(side("a"), "vid_a").join(side("b"), "vid_b")
        return (j if condition is None else j.where(condition)).select(
            *[f"{c}_a" for c in [*cols, "vid"]], *[f"{c}_b" for c in [*cols, "vid"]], "sim")
    vecs = vector_table(nodes, prefix_threshold if prefix_threshold is not None else threshold)
    if materialise:
        vecs = cut_lineage(vecs)
    np_ = _prefix_postings(nodes, vecs, cols)
    a, b = np_.alias("a"), np_.alias("b")
    cond = F.col("a.token") == F.col("b.token")
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    cond = cond & _bounded("a.", "b.", max(threshold - PREFIX_SLACK, 0.0))
    j = a.join(b, cond).select(*[F.col(f"a.{c}").alias(f"{c}_a") for c in cols + ["vid"]],
                               *[F.col(f"b.{c}").alias(f"{c}_b") for c in cols + ["vid"]])
    if condition is not None:
        j = j.where(condition)
    keep = F.col("sim") > threshold if strict else F.col("sim") >= threshold
    return verify(vecs, j.dropDuplicates(), threshold).where(keep)


# Work bounds of the existence search (exact either way; these only decide
# how much is settled by the cheap first pass).
NEIGHBOURS = 8          # earlier entries checked per posting in the first pass
POSITION_BLOCK = 4096   # first-pass windows cover this many positions


def earlier_similar(nodes: DataFrame, scope: Sequence[str], threshold: float,
                    thr_col: str | None = None, order_col: str = "first_pos",
                    neighbours: int = NEIGHBOURS, block: int = POSITION_BLOCK, n_bytes: int | None = None) -> DataFrame:
    """Positions (``order_col``) of nodes that have an earlier node in the same
    scope with cosine >= threshold (``thr_col``: the later node's own one).

    Exact, without listing all pairs of a dense cluster. Without a scope the nodes meet by
    blocks (``n_bytes``: about the size of their words, if known). In a scope:
    1. each prefix posting is compared with the ``neighbours`` entries just
       before it in its (scope, token, position block) window -- inside a
       cluster of near-copies the previous copy usually settles it;
    2. only nodes still undecided are compared with every earlier entry of
       their prefix tokens (the complete candidate set for them).
    """
    cols = list(dict.fromkeys(list(scope) + [order_col] + ([thr_col] if thr_col else [])))
    if not scope:
        thr = F.col(thr_col) if thr_col else F.lit(float(threshold))
        words = nodes.where(F.col(order_col).isNotNull() & (F.size("canon") > 0)).select(
            F.col(order_col).alias("key"), F.col(order_col).cast("long").alias("pos"), F.array_join("canon", " ").alias("terms"), thr.cast("double").alias("thr"))
        n_bytes = size_of("terms", words) if n_bytes is None else n_bytes
        near = blockjoin.similar(words, n_bytes, unit=True, earlier=True)
        ok = near.where(sim_expr(F.col("dot"), F.col("n2_a"), F.col("n2_b")) >= F.col("thr"))
        return ok.select(F.col("key_b").alias(order_col)).distinct()
    # nodes are one aggregation over already materialised rows: recomputing
    # them is cheaper than writing them; the vector table is materialised
    nodes = nodes.select(*cols, "vid", "canon")
    vecs = cut_lineage(vector_table(nodes, threshold))
    np_ = _prefix_postings(nodes, vecs, cols)
    thr = F.col(f"{thr_col}_b") if thr_col else F.lit(threshold)
    least = max(threshold - PREFIX_SLACK, 0.0)

    def flagged(pairs: DataFrame) -> DataFrame:
        asked = ["vid_a", "vid_b", f"{order_col}_b", *([f"{thr_col}_b"] if thr_col else [])]
        ok = verify(vecs, pairs.select(*asked).dropDuplicates(), threshold).where(F.col("sim") >= thr)
        return ok.select(F.col(f"{order_col}_b").alias(order_col)).distinct()

    def sided(s: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{s}") for c in [*cols, "vid"]] + [F.col(c).alias(f"{s}_{c}") for c in BOUNDS]

    # pass 1: bounded neighbours in position blocks
    w = (Window.partitionBy(*scope, "token", F.floor(F.col(order_col) / block))
         .orderBy(order_col).rowsBetween(-neighbours, -1))
    near1 = np_.select(*sided("b"), F.collect_list(F.struct("vid", *BOUNDS)).over(w).alias("_prev"))
    near1 = near1.withColumn("_a", F.explode("_prev")).drop("_prev")
    near1 = near1.select("*", F.col("_a.vid").alias("vid_a"), *[F.col(f"_a.{c}").alias(f"a_{c}") for c in BOUNDS])
    first = cut_lineage(flagged(near1.where(_bounded("a_", "b_", least))))

    # pass 2: every earlier entry, for the undecided nodes only
    undecided = np_.join(first, order_col, "left_anti")
    a, b = np_.select("token", *sided("a")), undecided.select("token", *sided("b"))
    keys = ["token"]
    for c in scope:
        a = a.withColumnRenamed(f"{c}_a", c)
        b = b.withColumnRenamed(f"{c}_b", c)
        keys.append(c)
    rest = a.join(b, keys).where((F.col(f"{order_col}_a") < F.col(f"{order_col}_b")) & _bounded("a_", "b_", least))
    return first.unionByName(flagged(rest)).distinct()


def vector_columns(df: DataFrame, tokens: Column) -> DataFrame:
    """Add ``vid`` and ``canon`` for a token-list expression."""
    return (df.withColumn("canon", canonical_tokens(tokens))
              .withColumn("vid", F.md5(F.array_join(F.col("canon"), " "))))
