"""Leakage between splits and set operations (LEK-*, DUP-08).

Shared texts are found by grouping, not by joining splits against each other: per
text only the set of splits it occurs in is kept, so a text copied a million times
yields one row per pair of its splits. Groups are formed on a 128-bit hash of the
text, so texts are not shuffled. Any split names are compared; the three usual pairs
are always listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.functions import text as T
from textcurate.operators import simjoin
from textcurate.session import cut_lineage

# Split names in order and the three pairs compared.
SPLITS = ["train", "validation", "test"]
PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]
GATE_MAX_SHARE = 0.01


def split_rank(c) -> F.Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SPLITS]), c), F.lit(99))


def pair_dim(spark) -> DataFrame:
    return spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in PAIRS],
                                 "pair string, split_a string, split_b string")


def _all_pairs(spark, counts: DataFrame) -> DataFrame:
    """The usual pairs and any others that were found, named a-b."""
    usual = pair_dim(spark).select("split_a", "split_b")
    return usual.join(counts, ["split_a", "split_b"], "full").withColumn("pair", F.concat_ws("-", "split_a", "split_b"))


def shared_pairs(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, split_a, split_b) for every key present in two splits."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("_s"))
    sets = sets.where(F.size("_s") > 1)
    ex = sets.select(key, F.posexplode("_s").alias("_i", "split_a"), "_s")
    ex = ex.select(key, "split_a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("split_b"))
    # canonical pair order: train < validation < test
    a, b = F.col("split_a"), F.col("split_b")
    swap = split_rank(a) > split_rank(b)
    return ex.select(key, F.when(swap, b).otherwise(a).alias("split_a"),
                     F.when(swap, a).otherwise(b).alias("split_b"))


def leak_counts(spark, df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """LEK-01: distinct shared texts per split pair, with a leaked verdict."""
    sp = shared_pairs(df.select(F.md5(text).alias("_h"), F.col(split).alias("split")), "_h")
    c = sp.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return _all_pairs(spark, c).select("pair", shared.alias("shared"), (shared > 0).alias("leaked"))


def leak_detail(df: DataFrame, text: str = "text", label: str = "label",
                split: str = "split", order: str = "id") -> DataFrame:
    """LEK-02: each shared text with the first label seen on each side."""
    hashed = df.select(F.md5(text).alias("_h"), F.col(split).alias("split"), F.col(label).alias("_l"), F.col(order).alias("_o"))
    # per text and split the first label; then all splits of a text in one small row
    first = hashed.groupBy("_h", "split").agg(F.min_by("_l", "_o").alias("label"), F.min("_o").alias("_o"))
    sides = first.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct(
        split_rank(F.col("split")).alias("r"), "split", "label"))).alias("s"), F.min("_o").alias("_o")).where(F.size("s") > 1)
    pairs = sides.select("_h", "_o", F.posexplode("s").alias("i", "a"), "s").select(
        "_h", "_o", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    # one row of each shared text brings the text itself
    texts = df.select(F.col(order).alias("_o"), F.md5(text).alias("_h"), F.col(text).alias("_text"))
    return pairs.join(texts, ["_o", "_h"]).select(
        F.concat_ws("-", "a.split", "b.split").alias("pair"), F.col("_text").alias(text), F.col("a.label").alias("label_a"),
        F.col("b.label").alias("label_b"))


def leak_gate(df: DataFrame, text: str = "text", split: str = "split",
              a: str = "train", b: str = "validation") -> DataFrame:
    """LEK-03: shared distinct a/b texts over distinct b texts; pass if < 1 %.
    An empty b side gives a null share (and no pass), not a division error."""
    d = df.where(F.col(split).isin(a, b)).select(F.md5(text).alias("_h"), F.col(split).alias("split"))
    per_text = d.groupBy("_h").agg(F.count_if(F.col("split") == a).alias("_a"),
                                   F.count_if(F.col("split") == b).alias("_b"))
    agg = per_text.agg(F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("shared"),
                       F.count_if(F.col("_b") > 0).alias("distinct_b"))
    share = F.when(F.col("distinct_b") == 0, F.lit(None).cast("double")) \
             .otherwise(F.col("shared") / F.col("distinct_b"))
    return agg.select(F.coalesce("shared", F.lit(0)).cast("long").alias("shared"),
                      F.coalesce("distinct_b", F.lit(0)).cast("long").alias("distinct_validation"),
                      share.alias("share"), F.coalesce(share < GATE_MAX_SHARE, F.lit(False)).alias("passed"))


def id_overlap(spark, df: DataFrame, idc: str = "id", split: str = "split") -> DataFrame:
    """LEK-04: ids shared by each split pair; ``ok`` when none."""
    sp = shared_pairs(df.select(idc, split), idc, split)
    c = sp.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("overlap"))
    ov = F.coalesce("overlap", F.lit(0)).cast("long")
    return _all_pairs(spark, c).select("pair", ov.alias("overlap"), (ov == 0).alias("ok"))


def cross_split_links(df: DataFrame, text: str = "clean_text", split: str = "split", idc: str = "id",
                      threshold: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """DUP-08: (links, members). A link is an unordered pair of word bags (vid_a <= vid_b)
    with cosine > threshold (strict) that occur in different splits; members are the rows
    (id, split, vid) of linked bags. Copies of a text are members, not links; so a dense group costs its members and the links
    between its distinct texts. ``representative_pairs`` and ``row_pairs`` read the two.
    Rows without a word are similar to nothing."""
    v = simjoin.vector_columns(df.select(F.col(idc).alias("id"), F.col(split).alias("split"), text), T.words(T.dup_key(text)))
    v = v.where(F.size("canon") > 0)
    return linked_bags(v.select("id", "split", "vid"), v.select("vid", F.array_join("canon", " ").alias("terms")), threshold, simjoin.size_of(text, df))


def linked_bags(rows: DataFrame, words: DataFrame, threshold: float, n_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``cross_split_links`` of rows (id, split, vid) and the words of their bags (vid, terms:
    sorted, joined by spaces; a bag may come several times), of about ``n_bytes``."""
    # one text per bag, not stored; rows and splits of bags are
    bags = words.groupBy("vid").agg(F.first("terms").alias("terms"))
    v = cut_lineage(rows)
    splits = v.groupBy("vid").agg(F.collect_set("split").alias("splits"))
    side = lambda x: splits.select(F.col("vid").alias(f"vid_{x}"), F.col("splits").alias(f"splits_{x}"))
    pairs = simjoin.similar_texts(bags, threshold, True, n_bytes)
    links = pairs.join(side("a"), "vid_a").join(side("b"), "vid_b").where(
        F.size(F.array_union("splits_a", "splits_b")) > 1).select("vid_a", "vid_b", "sim")
    if threshold < 1.0:  # copies in two splits
        same = splits.where(F.size("splits") > 1)
        links = links.unionByName(same.select(F.col("vid").alias("vid_a"), F.col("vid").alias("vid_b"), F.lit(1.0).alias("sim")))
    links = cut_lineage(links)
    linked = links.select(F.explode(F.array("vid_a", "vid_b")).alias("vid")).distinct()
    return links, v.select("id", "split", "vid").join(linked, "vid", "left_semi")


def _in_split_order(links: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """Links with both sides' ``columns`` where the splits differ, the earlier split first."""
    def side(s: str) -> DataFrame:
        return sides.select(F.col("vid").alias(f"v{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("split", *columns)])

    # each link both ways round, so that every pair of splits meets its earlier side first
    ways = F.array(F.struct(F.col("vid_a").alias("va"), F.col("vid_b").alias("vb")), F.struct(F.col("vid_b").alias("va"), F.col("vid_a").alias("vb")))
    both = links.select("sim", F.explode(F.array_distinct(ways)).alias("w")).select("sim", "w.*")
    return both.join(side("a"), "va").join(side("b"), "vb").where(
        (split_rank(F.col("split_a")) < split_rank(F.col("split_b")))
        | ((split_rank(F.col("split_a")) == split_rank(F.col("split_b"))) & (F.col("split_a") < F.col("split_b"))))


def representative_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """pair, vid_a, vid_b, sim, n_pairs (row pairs that it stands for), id_a, id_b (the
    smallest id of either side)."""
    sides = members.groupBy("vid", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return _in_split_order(links, sides, ["n", "id"]).select(
        F.concat_ws("-", "split_a", "split_b").alias("pair"), F.col("va").alias("vid_a"), F.col("vb").alias("vid_b"), "sim",
        (F.col("n_a") * F.col("n_b")).cast("long").alias("n_pairs"), "id_a", "id_b")


def row_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All similar row pairs: pair, id_a, id_b, sim. As many rows as there are pairs."""
    return _in_split_order(links, members, ["id"]).select(F.concat_ws("-", "split_a", "split_b").alias("pair"), "id_a", "id_b", "sim")


def with_texts(pairs: DataFrame, rows: DataFrame, text: str = "text", idc: str = "id") -> DataFrame:
    """The texts of id_a and id_b added."""
    for s in ("a", "b"):
        pairs = pairs.join(rows.select(F.col(idc).alias(f"id_{s}"), F.col(text).alias(f"text_{s}")), f"id_{s}")
    return pairs
