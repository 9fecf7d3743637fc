"""Quality rules by cross-document line frequency (native).

Lines are normalised (lower case, white space collapsed) and hashed to 96 bits.
For each host the distinct documents that hold a line are counted (copies of one
text count once, so a copied document does not make its own lines boilerplate). A
line held by more of them than an absolute limit, however large the host, is removed;
so is one held by more than a share of the host's, from a floor on, in small hosts.
A document that loses too large a
share of its words is depleted and rejected; so is one that fails the base rules.

Counting is a two-level distinct aggregation, so a line in a third of all rows is
combined before the shuffle; the frequent lines come back by an equi-join that
adaptive execution splits when skewed. No text is shuffled.

Defined cases: a null or empty text has no words, fails the base rule and is not
kept; a null host is a host of its own; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SEPARATOR, SEPARATORS, same_row, text_key, whole_text, words

# Fixed value: the characters counted as symbols.
SYMBOLS = "[^#*$%&|<>]+"


def once(value: Column, use) -> Column:
    """use(value) with the value bound to a lambda's variable: it is computed once, even
    if the plan moves the expression, where a column's expression would be copied into
    every inner loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more in the array.

    Windows are 64-bit hashes. If all are distinct, as in most texts, the answer
    is 0; otherwise the (hash, position) pairs are sorted, equal neighbours marked,
    and the positions that they cover counted."""
    def windows(a):
        return F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))

    def covered(p):
        marked = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                          | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(
            marked, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(once(pairs, covered))

    return once(w, lambda a: F.when(F.size(a) < 3, 0).otherwise(once(windows(a), count))).cast("long")


def text_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SEPARATOR))


def line_hash(line: Column) -> Column:
    """Hash of the normalised line, 96 bits."""
    norm = F.trim(F.regexp_replace(F.lower(line), SEPARATORS, " "))
    return F.struct(F.xxhash64(norm).alias("h1"), F.hash(norm).alias("h2"))


def base_rules(docs: DataFrame, least_words: int = 50, most_repeat_pct: int = 50) -> DataFrame:
    """doc_id, text_key and the base statistics of each row; no shuffle."""
    t = docs.select("doc_id", whole_text().alias("text"))
    w = t.select("doc_id", "text", words(F.col("text")).alias("w"))
    lines = text_lines(F.col("text"))
    out = w.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_pct * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per line occurrence: doc_id, text_key, host, pos, h1, h2, n (words)."""
    t = docs.select("doc_id", F.col(host).cast("string").alias("host"), whole_text().alias("text"))
    per_line = F.transform(text_lines(F.col("text")), lambda x: F.struct(
        line_hash(x).alias("h"), F.size(words(x)).cast("long").alias("n")))
    return t.select("doc_id", text_key(F.col("text")).alias("text_key"), "host", F.posexplode(per_line).alias("pos", "l")).select(
        "doc_id", "text_key", "host", "pos", F.col("l.h.h1").alias("h1"), F.col("l.h.h2").alias("h2"), F.col("l.n").alias("n"))


def frequent_lines(lines: DataFrame, docs: DataFrame, host: str = "source", least_docs: int = 20,
                   host_share: float = 0.10, floor_docs: int = 5) -> DataFrame:
    """(host, h1, h2) of the lines held by more than ``least_docs`` distinct texts
    of the host, or by more than ``host_share`` of them and ``floor_docs``."""
    held = lines.groupBy("host", "h1", "h2").agg(F.countDistinct("text_key").alias("n_docs")).filter(
        F.col("n_docs") > min(least_docs, floor_docs))
    hosts = docs.select(F.col(host).cast("string").alias("o_host"), text_key(whole_text()).alias("o_key")).groupBy(
        "o_host").agg(F.countDistinct("o_key").alias("host_docs"))
    return held.join(hosts, held["host"].eqNullSafe(hosts["o_host"])).filter(
        (F.col("n_docs") > least_docs) | ((F.col("n_docs") > floor_docs) & (F.col("n_docs") > host_share * F.col("host_docs")))).select("host", "h1", "h2")


def line_frequency_rules(docs: DataFrame, host: str = "source", least_words: int = 50, most_repeat_pct: int = 50,
                         least_docs: int = 20, host_share: float = 0.10, depleted_share: float = 0.5, floor_docs: int = 5) -> DataFrame:
    """Per row: doc_id, text_key, the base statistics, n_removed_words,
    removed (the hashes of its removed lines), depleted and kept."""
    lines = line_rows(docs, host)
    often = frequent_lines(lines, docs, host, least_docs, host_share, floor_docs).select(
        F.col("host").alias("o_host"), F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    gone = lines.join(often, lines["host"].eqNullSafe(often["o_host"]) & (lines["h1"] == often["o1"]) & (
        lines["h2"] == often["o2"]), "left_semi")
    # a repeated row brings the same (row, position) again: it counts once
    per_line = gone.dropDuplicates(["doc_id", "text_key", "pos"])
    per_doc = per_line.groupBy("doc_id", "text_key").agg(
        F.sum("n").alias("n_removed_words"), F.collect_set(F.struct("h1", "h2")).alias("removed"))
    base = base_rules(docs, least_words, most_repeat_pct)
    out = base.join(per_doc, same_row(base, per_doc), "left").select(
        base["*"], F.coalesce(per_doc["n_removed_words"], F.lit(0)).cast("long").alias("n_removed_words"),
        F.coalesce(per_doc["removed"], F.array().cast("array<struct<h1:bigint,h2:int>>")).alias("removed"))
    out = out.withColumn("depleted", F.col("n_removed_words") > depleted_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in ``removed``."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_hash(x)))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))
