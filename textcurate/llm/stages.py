"""Pipeline stages: each applies one operator's decisions to documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``docs`` in their order (the last one adds its own). Extra columns pass through
whatever their names. Where a text changes, ``n_chars`` follows if it is there.
Rows with a null text stay unless the operator rejects them; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, lsh_forest, mixing, quality, winnow
from .common import read_table, text_key, whole_text


def _matched(docs: DataFrame, found: DataFrame, columns: list[str], how: str) -> tuple[DataFrame, dict[str, Column]]:
    """docs joined with the per-row results of an operator, by (doc_id, text_key);
    the results come under names that cannot clash."""
    free = _free_name(docs)
    f = found.select(F.col("doc_id").alias(f"{free}id"), F.col("text_key").alias(f"{free}key"),
                     *[F.col(c).alias(f"{free}{c}") for c in columns]).dropDuplicates([f"{free}id", f"{free}key"])
    both = docs.join(f, docs["doc_id"].eqNullSafe(f[f"{free}id"]) & (text_key(whole_text()) == f[f"{free}key"]), how)
    return both, {c: F.col(f"{free}{c}") for c in columns}


def _all(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _free_name(docs: DataFrame) -> str:
    free = "_r_"
    while any(c.startswith(free) for c in docs.columns):
        free = "_" + free
    return free


def _with_text(joined: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns with the new text; null texts stay null."""
    new = F.when(F.col("text").isNotNull(), text)
    return joined.select(*[new.alias(c) if c == "text" else F.coalesce(F.char_length(new), F.col(c)).cast("long").alias(c)
                           if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents; removes frequent lines from the others."""
    verdicts = quality.line_frequency_rules(docs).filter("kept")
    both, r = _matched(docs, verdicts, ["removed"], "inner")
    return _with_text(both, docs.columns, quality.without_lines(whole_text(), r["removed"]))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which no word is left goes."""
    found = line_dedup.dedup_lines(docs).filter("n_removed > 0")
    both, r = _matched(docs, found, ["removed"], "left")
    removed = F.coalesce(r["removed"], F.array().cast("array<int>"))
    text = line_dedup.without_positions(whole_text(), removed)
    return _with_text(both.filter((F.size(removed) == 0) | text.rlike(r"[^\x20\x09-\x0D]")), docs.columns, text)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of smallest doc_id (of
    different texts with that id the one of smallest text key); of repeated rows of it one
    stays. Rows without an id all stay."""
    found = lsh_forest.near_duplicates(docs).filter("first and doc_id is not null")
    both, _ = _matched(docs, found, [], "left_semi")
    stay = both.withColumn(f"{_free_name(docs)}key", text_key(whole_text())).dropDuplicates(["doc_id", f"{_free_name(docs)}key"])
    return stay.select(_all(docs)).unionByName(docs.filter(F.col("doc_id").isNull()).select(_all(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = winnow.find_contamination(docs, read_table(spark, sf_dir, "benchmark")).filter(winnow.is_contaminated())
    both, _ = _matched(docs, found, [], "left_anti")
    return both.select(_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with mix_weight and mix_probability added (columns of these
    names are replaced)."""
    rows = mixing.measured(docs)
    mixed = mixing.mix_to_targets(rows).filter("kept")
    free = _free_name(docs)
    chosen = mixed.select(F.col("doc_id").alias(f"{free}id"), "source", "lang", "topic", F.col("weight").alias(f"{free}w"),
                          F.col("probability").alias(f"{free}p"))
    # a row is found again by its id and cell: repeated rows are decided alike
    cell = docs.select("*", *[c.alias(f"{free}{n}") for n, c in mixing.cell_columns(docs).items()])
    names = ("source", "lang", "topic")
    chosen = chosen.select(f"{free}id", f"{free}w", f"{free}p", *[F.col(c).alias(f"{free}c_{c}") for c in names]).dropDuplicates(
        [f"{free}id", *[f"{free}c_{c}" for c in names]])
    on = cell["doc_id"].eqNullSafe(chosen[f"{free}id"])
    for c in names:
        on = on & cell[f"{free}{c}"].eqNullSafe(chosen[f"{free}c_{c}"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_weight", "mix_probability")]
    return cell.join(chosen, on).select(*kept, F.col(f"{free}w").alias("mix_weight"), F.col(f"{free}p").alias("mix_probability"))
