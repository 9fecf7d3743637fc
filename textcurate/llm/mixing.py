"""Mixing sources to target weights by iterative proportional fitting (native).

Documents are counted into cells (source, language, topic) with their tokens. The
cell weights are raked: scaled to the target marginal of each dimension in turn
until all hold. A document's calibrated ratio is its cell's fitted weight over its
observed share; it is sampled with probability min(1, budget * ratio), decided by
a hash of its id, and carries the weight by which an over-subscribed cell's
documents count more than once.

The cell table has one row per combination that occurs, built with map-side
partial sums, so a source with a third of all rows costs nothing. Up to
``cells_per_task`` counted cells are one partition, and a scaling is a window sum in it: no
exchange, no join, lineage cut every few rounds. More cells are grouped and joined in a
number of partitions that follows their count, cut after each round. The cell table is broadcast to the documents only if its counted rows are below ``broadcast_cells``;
beyond that the join is left to Spark.

Topic: the tables have none; ``topic_of`` derives a coarse one from the form of a
text. Any column can be passed instead.

Defined cases: null in a dimension is a category of its own; a null or empty text
has no tokens, adds nothing to its cell and keeps the cell's ratio (1 where the
cell has no tokens at all); repeated rows each count and are decided alike; an
empty table gives an empty result; input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.session import cut_lineage

from .common import whole_text, words

DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column, n_words: Column) -> Column:
    """The form of a text: markup (a symbol per 50 characters or more), list (a
    line per 8 words or fewer), long (800 words or more), short (under 100), prose."""
    n = F.char_length(text)
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    lines = F.char_length(F.regexp_replace(text, r"[^\n]+", "")) + 1
    return (F.when(symbols * 50 >= F.greatest(n, F.lit(1)), "markup").when(n_words <= lines * 8, "list")
            .when(n_words >= 800, "long").when(n_words < 100, "short").otherwise("prose"))


def cell_columns(docs: DataFrame) -> dict[str, Column]:
    """The dimensions of a row, from its source, lang and text."""
    n_words = F.size(words(whole_text())).cast("long")
    return {"source": docs["source"].cast("string"), "lang": docs["lang"].cast("string"), "topic": topic_of(whole_text(), n_words)}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of each row."""
    return docs.select("doc_id", *[c.alias(n) for n, c in cell_columns(docs).items()],
                       F.size(words(whole_text())).cast("long").alias("n_tokens"))


def target_marginal(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """(value, target): shares of the categories that have tokens, flattened by
    raising the observed shares to ``temperature`` (1: as observed, 0: equal)."""
    seen = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(temperature)).alias("t"))
    total = seen.agg(F.sum("t")).first()[0]
    return seen.select(F.col(dim).alias("value"), (F.col("t") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, parts: int = 1) -> DataFrame:
    """Iterative proportional fitting of ``share`` to the target marginals.

    Each round scales every dimension once; lineage is cut after each round. The
    cells stay in ``parts`` partitions, so few cells need no exchange."""
    dims = list(targets)
    fitted = cells.withColumn("fit", F.col("share"))
    for _ in range(rounds):
        for dim in dims:
            now = fitted.groupBy(dim).agg(F.sum("fit").alias("now"))
            aim = targets[dim]
            factor = now.join(aim, now[dim].eqNullSafe(aim["value"])).select(
                F.col("value"), (F.col("target") / F.col("now")).alias("factor"))
            fitted = fitted.join(factor, fitted[dim].eqNullSafe(factor["value"])).select(
                *[c for c in fitted.columns if c != "fit"], (F.col("fit") * F.col("factor")).alias("fit"))
        fitted = cut_lineage(fitted).coalesce(parts)
    return fitted


def rake_in_place(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, cut_every: int = 4) -> DataFrame:
    """``rake`` for cells that are few by count: one partition, every scaling a window."""
    fitted = cells.withColumn("fit", F.col("share"))
    for dim, aim in targets.items():
        named = aim.select(F.col("value").alias(f"v_{dim}"), F.col("target").alias(f"t_{dim}"))
        fitted = fitted.join(named, fitted[dim].eqNullSafe(named[f"v_{dim}"])).drop(f"v_{dim}")
    fitted = cut_lineage(fitted).coalesce(1)
    for i in range(1, rounds + 1):
        for dim in targets:
            now = F.sum("fit").over(Window.partitionBy(dim))
            fitted = fitted.withColumn("fit", F.col("fit") * F.col(f"t_{dim}") / now)
        if i % cut_every == 0 and i < rounds:
            fitted = cut_lineage(fitted).coalesce(1)
    return cut_lineage(fitted.drop(*[f"t_{d}" for d in targets])).coalesce(1)


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id: 52 bits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_to_targets(docs: DataFrame, temperatures: dict[str, float] | None = None, budget: float = 0.5,
                   rounds: int = 12, broadcast_cells: int = 200_000, cells_per_task: int = 50_000,
                   dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per row of ``docs`` (doc_id, the dimensions and n_tokens, see ``measured``):
    ratio (calibrated over observed), probability, weight and kept."""
    temperatures = temperatures or {"source": 0.5, "lang": 0.7, "topic": 0.7}
    # the narrow rows are read twice (cells, decisions): cut so texts are split once
    rows = cut_lineage(docs)
    cells = cut_lineage(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    n_cells, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    parts = max(1, -(-n_cells // cells_per_task))
    cells = cells.select(*dims, "tokens", (F.col("tokens") / F.lit(total or 1)).alias("share")).coalesce(parts)
    targets = {d: cut_lineage(target_marginal(cells, d, temperatures[d])).coalesce(parts) for d in dims}
    raked = rake_in_place(cells, targets, rounds) if parts == 1 else rake(cells, targets, rounds, parts)
    fitted = raked.select(*[F.col(d).alias(f"c_{d}") for d in dims],
                                                        (F.col("fit") / F.col("share")).alias("c_ratio"))
    if n_cells <= broadcast_cells:
        fitted = F.broadcast(fitted)
    on = None
    for d in dims:
        c = rows[d].eqNullSafe(fitted[f"c_{d}"])
        on = c if on is None else on & c
    out = rows.join(fitted, on, "left").select(*rows.columns, F.coalesce("c_ratio", F.lit(1.0)).alias("ratio"))
    wanted = F.col("ratio") * budget
    return (out.withColumn("probability", F.least(wanted, F.lit(1.0)))
            .withColumn("weight", F.greatest(wanted, F.lit(1.0)))
            .withColumn("kept", uniform(F.col("doc_id")) < F.col("probability")))
