"""MinHash near-duplicates by an LSH forest.

A document is the set of its distinct word shingles. Documents with equal sets form
one class; only classes go on. Each class gets
``trees`` MinHash signatures of ``depth`` labels. Every tree is one sorted order of
all signatures (a range partitioning with the id as last key, so no prefix, however
common, fills a task). A region is a set of classes with equal first labels in one tree:
``least`` labels, and where more than ``crowd`` classes share them, as many more as it
takes to part them, up to all ``depth``. Candidates:

* hubs: within a region the class whose whole
  signatures are shared most often is compared with every other one. In a large
  group of copies that is the text they were made from, so a group costs a number of
  comparisons linear in its size, not all its pairs;
* neighbours: each class and the ``near`` classes before it, as far as their longest
  common prefix is ``least`` labels or more, if they lie in different components still;
* the rest: classes that are still not connected with the hub of a region meet all
  others of it. Region members and such classes are dealt out in blocks of about
  ``block``; a task counts the common shingles of the two blocks by a matrix product and
  returns no pairs but the links that join components, fewer than the block has classes.

Hub pairs are confirmed on the full shingle sets first and components are formed;
then neighbour pairs that lie in different components, then the rest, whose counts are exact.
So every pair that shares a region is compared or connected otherwise, and the
components do not depend on hubs, neighbours, blocks or partitions: those only save
comparisons. For similarity 0.8, 16 trees
and 3 labels a pair shares no region with probability (1 - 0.8**3)**16, about 1e-5; with all 6
labels, in regions that stay crowded so far, 0.008.

Defined cases: null and empty texts have an empty set and are linked with nothing;
texts of fewer words than a shingle are one shingle; repeated rows are one node, rows of
one doc_id with different texts are nodes of their own; a null doc_id is never linked and is
kept; doc_id may be of any type with an order; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcurate.session import cut_lineage

from . import wordhash as W
from .common import text_key, whole_text, written
from .components import connected_components

TREES, DEPTH, LEAST, NEAR = 16, 6, 3, 4
CROWD = 2048  # classes of a region above which its prefix grows
BLOCK = 512  # classes of a region that meet in one task
COLUMNS = 4096  # shingles counted at a time


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(s: W.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per document) of the shingles of a slice, repeats included."""
    word_hash, n_words, _, _ = W.hashed_words(s, W.SPACES)
    if len(word_hash) == 0:
        return np.empty(0, np.uint64), np.zeros(len(n_words), np.int64)
    first = np.cumsum(n_words) - n_words
    doc_end = np.repeat(first + n_words, n_words)
    grams = np.empty(len(word_hash), np.uint64)
    whole = W.windows(word_hash, size)
    grams[:len(whole)] = whole
    inside = np.arange(len(word_hash)) + size <= doc_end
    for n in range(1, size):  # texts of fewer words: all of them are one shingle
        at = first[n_words == n]
        if len(at):
            h = word_hash[at].copy()
            for j in range(1, n):
                h = h * W.P + word_hash[at + j]
            grams[at] = W.finalize(h ^ np.uint64(n))
            inside[at] = True
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    return grams[inside], counts


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    (s,) = W.slices(pa.array([text], pa.string()))
    return np.unique(shingles(s, size)[0])


def _sketch(batches: Iterator[pa.RecordBatch], size: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    mul, add = multipliers(trees * depth)
    for batch in batches:
        for s in W.slices(batch.column(2)):
            h, counts = shingles(s, size)
            n = len(counts)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            labels = np.zeros((n, trees * depth), np.int32)
            for j in range(len(mul)):
                if len(some):
                    low = np.minimum.reduceat(h * mul[j] + add[j], starts)
                    labels[some, j] = (W.finalize(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            n_set, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for i, at in zip(some, starts, strict=True):
                u = np.unique(h[at:at + counts[i]])
                n_set[i], s1[i] = len(u), u.sum()
                s2[i] = np.bitwise_xor.reduce(W.finalize(u))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (trees * depth))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.first, n), batch.column(1).slice(s.first, n), pa.array(n_set), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(labels.ravel()))],
                ["doc_id", "text_key", "n_shingles", "s1", "s2", "labels"])


def sketch(docs: DataFrame, size: int = 4, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key, n_shingles, (s1, s2): a hash of the set, labels: trees x depth ints."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(whole_text()).alias("text_key"), whole_text().alias("text")).mapInArrow(
        partial(_sketch, size=size, trees=trees, depth=depth),
        f"doc_id {kind}, text_key long, n_shingles long, s1 long, s2 long, labels array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch], depth: int, least: int, near: int) -> Iterator[pa.RecordBatch]:
    """Walks one partition of the sorted order: the neighbours of every entry (-1:
    none). Those across partition bounds are left to the rest."""
    tail = np.empty((0, depth + 2), np.int64)
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        every = np.concatenate([tail, rows])
        off, n = len(tail), len(rows)
        keys, ids = every[:, :depth + 1], every[:, depth + 1]
        partners = np.full((n, near), -1, np.int64)
        for step in range(1, near + 1):
            at = np.arange(max(off, step), off + n)
            if len(at):
                close = (keys[at, :least + 1] == keys[at - step, :least + 1]).all(axis=1)
                partners[at[close] - off, step - 1] = ids[at[close] - step]
        tail = every[-near:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[off:]), pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * near), pa.array(partners.ravel()))], ["id", "partners"])


def forest(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per class and tree: tree, l1 .. l<depth>, id, n_shingles."""
    at = F.col("tree") * depth
    return classes.select("id", "n_shingles", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "tree", *[F.get("labels", at + j).alias(f"l{j + 1}") for j in range(depth)], "id", "n_shingles")


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a = batch.column(0)[i].as_py()
            if a != last:  # pairs come sorted by a: its set serves them all
                last, known = a, shingle_set(batch.column(2)[i].as_py(), size)
            other = shingle_set(batch.column(3)[i].as_py(), size)
            small, large = sorted((len(known), len(other)))
            if 100 * small < percent * large:
                continue
            both = len(np.intersect1d(known, other, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(known) + len(other) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach the similarity; ``texts``: id, text."""
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(partial(_confirm, size=size, percent=percent), "a long, b long")


def deepened(entries: DataFrame, least: int, depth: int, crowd: int) -> tuple[DataFrame, list[str]]:
    """``entries`` and the columns that name a region: the tree, ``least`` labels, and a
    label more for each region that has more than ``crowd`` classes still."""
    region = ["tree", *[f"l{j + 1}" for j in range(least)]]
    for j in range(least, depth):
        large = written(entries.groupBy(region).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select(region), "large")
        if large.isEmpty():
            break
        named = large.select(*[F.col(c).alias(f"g_{c}") for c in region], F.lit(True).alias("g_large"))
        on = [entries[c] == named[f"g_{c}"] for c in region]
        # in a region that is not split all classes have the same 0 here
        entries = entries.join(named, on, "left").withColumn(f"d{j + 1}", F.when(F.col("g_large"), F.col(f"l{j + 1}")).otherwise(0)).drop(
            *[f"g_{c}" for c in region], "g_large")
        region = [*region, f"d{j + 1}"]
    return entries, region


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "g"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every set of ``left`` with every one of ``right``: a product of
    0/1 matrices, some elements at a time. Elements of one side alone are left out."""
    in_left, in_right = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(in_left, in_right)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        hit = shared[np.minimum(at, len(shared) - 1)] == flat
        return row[hit], at[hit]

    if len(shared):
        rows_l, at_l = places(left, in_left)
        rows_r, at_r = places(right, in_right)
        for first in range(0, len(shared), COLUMNS):
            a, b = (np.zeros((n, COLUMNS), np.float32) for n in out.shape)
            for m, rows, at in ((a, rows_l, at_l), (b, rows_r, at_r)):
                here = (at >= first) & (at < first + COLUMNS)
                m[rows[here], at[here] - first] = 1
            out += a @ b.T
    return out.astype(np.int64)  # sums of ones: exact below 2**24


def joining_links(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks, each (ids, components, sets): those that join components,
    found by a union of components, so at most one fewer than there are components."""
    (ids_l, comp_l, sets_l), (ids_r, comp_r, sets_r) = left, right
    both = common_counts(sets_l, sets_r)
    n_l, n_r = (np.array([len(x) for x in sets]) for sets in (sets_l, sets_r))
    linked = (100 * both >= percent * (n_l[:, None] + n_r[None, :] - both)) & (np.asarray(comp_l)[:, None] != np.asarray(comp_r)[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(comp_l[i]), find(comp_r[j])
        if x != y:
            root[x] = y
            out.append((ids_l[i], ids_r[j]))
    return out


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by meeting (all columns but the last four): side, component, id, set."""
    meeting, sides = None, None
    links: list[tuple[int, int]] = []

    def finished() -> list[tuple[int, int]]:
        return joining_links(sides[0], sides[1], percent) if meeting is not None and sides[0][0] and sides[1][0] else []

    for batch in batches:
        k = batch.num_columns - 4
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(k)), strict=True))
        side, component, ids = (batch.column(k + c).to_pylist() for c in range(3))
        sets = batch.column(k + 3)
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        for i, key in enumerate(keys):
            if key != meeting:
                links += finished()
                meeting, sides = key, (([], [], []), ([], [], []))
            mine = sides[side[i]]
            mine[0].append(ids[i])
            mine[1].append(component[i])
            mine[2].append(values[offsets[i]:offsets[i + 1]].copy())
        if links:
            yield _link_rows(links)
            links = []
    links += finished()
    yield _link_rows(links)


def _link_rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])


def rest_of_regions(entries: DataFrame, hubs: DataFrame, formed: DataFrame, region: list[str], texts: DataFrame, size: int,
                    percent: int, block: int) -> DataFrame:
    """Links of classes that are not in the component of their region's hub, with all others
    of the region, as far as they join components."""
    of = formed.select("node", "component")
    named = written(entries.join(of, F.col("id") == F.col("node"), "left").select(
        *region, "id", F.coalesce("component", "id").alias("component")), "regions")
    hub = named.join(hubs.select(*region, (-F.col("hub.minus")).alias("h")), region).filter("id = h").select(
        *region, F.col("component").alias("ch"))
    marked = named.join(hub, region).withColumn("away", F.col("component") != F.col("ch"))
    counts = marked.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.count_if("away").alias("n_away")).filter("n_away > 0")
    marked = written(marked.join(counts, region).select(
        *region, "id", "component", "away", F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("n_away") / block).alias("away_blocks")), "marked")

    def dealt(seed: int, blocks: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(blocks))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    members = marked.select(*region, dealt(1, "blocks").alias("block"), every("away_blocks").alias("away_block"), F.lit(1).alias("side"), "component", "id")
    away = marked.filter("away").select(*region, every("blocks").alias("block"), dealt(2, "away_blocks").alias("away_block"), F.lit(0).alias("side"), "component", "id")
    involved = texts.join(marked.select("id").distinct(), "id", "left_semi")
    sets = written(involved.select("id", "text").mapInArrow(partial(_set_rows, size=size), "id long, g array<long>"), "sets")
    meeting = [*region, "block", "away_block"]
    rows = members.unionByName(away).join(sets, "id").select(*meeting, "side", "component", "id", "g")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *meeting).sortWithinPartitions(*meeting, "side", "id").mapInArrow(
        partial(_meet, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, trees: int = TREES, depth: int = DEPTH,
                    least: int = LEAST, near: int = NEAR, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept and text_key. ``first`` is
    true for the rows of one document of each component, the one of smallest doc_id (and
    text_key, among different texts of that id)."""
    spark = docs.sparkSession
    sketched = cut_lineage(sketch(docs, size, trees, depth))
    members = sketched.select("doc_id", "text_key", "n_shingles", "s1", "s2")
    # classes are numbered once, in a kept table: nodes are numbers, whatever doc_id is
    named = cut_lineage(members.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep")).withColumn("id", F.monotonically_increasing_id()))
    reps = named.select("id", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_key").alias("r_key"))
    of_rep = (F.col("doc_id") == F.col("r_id")) & (F.col("text_key") == F.col("r_key"))
    classes = sketched.join(reps, of_rep).select("id", "n_shingles", "labels").dropDuplicates(["id"])
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("text_key", text_key(F.col("text"))).join(
        reps, of_rep).select("id", "text").dropDuplicates(["id"])
    entries = forest(classes, trees, depth)
    region = ["tree", *[f"l{j + 1}" for j in range(least)]]
    order = ["tree", *[f"l{j + 1}" for j in range(depth)], "id"]
    # regions of one class alone are left out of the sorted orders
    crowded = entries.groupBy(region).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    entries = cut_lineage(entries.join(crowded, region, "left_semi"))
    entries, region = deepened(entries, least, depth, crowd)
    texts = written(texts.join(entries.select("id").distinct(), "id", "left_semi"), "texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = cut_lineage(entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(order).mapInArrow(
        partial(_neighbours, depth=depth, least=least, near=near), "id long, partners array<long>"))
    # hub: the class whose whole signatures are shared most often over all trees
    shared = entries.groupBy(order[:-1]).agg(F.count(F.lit(1)).alias("n"))
    score = entries.join(shared, order[:-1]).groupBy("id").agg(F.sum("n").alias("score"))
    # (as a table, so the join below is one of two plain exchanges, which can be split)
    hubs = written(entries.join(score, "id").groupBy(region).agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("hub")), "hubs")
    star = entries.select(*region, "id").join(hubs, region).select(
        (-F.col("hub.minus")).alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    links = cut_lineage(confirm(star, texts, size, percent))
    formed = connected_components(links)
    pairs = walked.select("id", F.explode("partners").alias("p")).filter("p >= 0").select(
        F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    of_a = formed.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = formed.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.unionByName(cut_lineage(confirm(apart, texts, size, percent)))
    rest = rest_of_regions(entries, hubs, connected_components(links), region, texts, size, percent, block)
    joined = connected_components(links.unionByName(cut_lineage(rest)))
    of_node = named.join(joined, named["id"] == joined["node"], "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), "rep", F.coalesce("component", "id").alias("component"))
    # a component is named by its smallest document (combined before the shuffle)
    smallest = of_node.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = of_node.join(smallest, "component").select("c1", "c2", "cn", "least")
    out = members.join(of_class, (members["s1"] == of_class["c1"]) & (members["s2"] == of_class["c2"]) & (
        members["n_shingles"] == of_class["cn"]), "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    linked = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("doc_id", "n_shingles", linked.alias("component_id"), F.col("doc_id").eqNullSafe(linked).alias("kept"), "text_key",
                      (alone | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))).alias("first"))
