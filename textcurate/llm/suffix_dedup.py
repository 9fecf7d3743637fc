"""Exact removal of repeated byte strings by sampled suffixes.

A byte is removed when a string of ``length`` bytes that covers it also starts
somewhere else, in any document. The text is the concatenation of all documents,
and matches never cross one. The plan is that of a difference-cover construction,
bounded to ``length`` bytes of every suffix:

1. *Sample.* A set of positions such that any two equal strings of ``length``
   bytes hold a sampled position at the same offset: in every run of ``length``
   bytes the ``core``-byte string of smallest hash (ties: all). A fixed difference
   cover modulo v has the same property but needs 9 % of all positions at this
   length (12 of 133), six times as many rows; this cover takes 2 in 122.
2. *Sort and name.* A sample is a triple: the bytes before it, its core and the
   bytes after it, as far as a string of ``length`` bytes around the core can
   reach. The core's hash is one name; the whole triple's hash is a second.
   Since prefixes end after ``length`` bytes, names need no deeper recursion.
3. Equal triples: every string inside is repeated; their reach is removed.
4. *Merge the remaining suffixes.* A core that occurs more than once with a triple
   that does not: the suffixes that start before it, at every offset, are
   compared with those of the other samples of that core, by the hash of their
   ``length``-byte prefix, sorted next to each other.

Names are counted with partial aggregation. Samples of step 4 meet by core, each
triple once, so a passage in a third of all texts is a few rows wherever its
surroundings agree; a core with more than ``crowd`` different triples is taken
apart into its single prefixes, which are grouped by their own hash.

Defined cases: null and empty texts, and texts under ``length`` bytes, lose
nothing; a repeated row is another document and so loses everything that is long
enough; an empty table gives an empty result; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import whole_text, written
from .winnow import slide

LENGTH, CORE = 200, 80
SPAN_TYPE = "array<struct<s:int,e:int>>"


def row_name(doc_id, text):
    return F.xxhash64(doc_id, text)


def sample(data: np.ndarray, bounds: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums, sampled positions) of a slice of whole documents."""
    sums = W.prefix_sums(data)
    n, width = len(data), length - core + 1
    if n < length:
        return sums, np.empty(0, np.int64)
    at = np.arange(n - core + 1)
    names = W.range_hash(sums, at, at + core) | np.uint64(1)
    least = slide(names, width, np.minimum)
    crossing = bounds[1:-1]  # no string of `length` bytes may hold such a bound inside
    if len(crossing):
        mark = np.zeros(n + 2, np.int32)
        np.add.at(mark, np.clip(crossing - length + 1, 0, n), 1)
        np.add.at(mark, np.clip(crossing, 0, n), -1)
        least = np.where(np.cumsum(mark[:len(least)]) > 0, np.uint64(0), least)
    padded = np.zeros(len(names) + width - 1, np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    return sums, np.flatnonzero(slide(padded, width, np.maximum) == names)


def reach(at: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of what strings of ``length`` bytes around the cores can cover."""
    return np.maximum(at - (length - core), doc_start), np.minimum(at + length, doc_end)


def _sample_batches(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in W.slices(batch.column(1)):
            sums, at = sample(s.data, s.bounds, length, core)
            doc = np.searchsorted(s.bounds, at, "right") - 1
            start, end = s.bounds[doc], s.bounds[doc + 1]
            lo, hi = reach(at, start, end, length, core)
            name = W.range_hash(sums, at, at + core)
            triple = W.finalize(W.range_hash(sums, lo, hi) ^ (at - lo).astype(np.uint64))
            rows = batch.column(0).to_numpy(zero_copy_only=False)[s.first + doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array((at - start).astype(np.int32)), pa.array((lo - start).astype(np.int32)),
                 pa.array((hi - start).astype(np.int32)), pa.array(name.view(np.int64)), pa.array(triple.view(np.int64))],
                ["row", "at", "lo", "hi", "name", "triple"])


def _cut_contexts(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """(row, text, samples) -> the bytes around every sample."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row, text, samples in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for x in samples.as_py():
                lo, hi = max(0, x["at"] - (length - core)), min(len(raw), x["at"] + length)
                for col, v in zip(out, (x["name"], row, lo, raw[lo:hi]), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                          pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["name", "row", "lo", "bytes"])


def _prefixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in the batch, start in the document, hash) of every string of
    ``length`` bytes in the contexts of a batch (name, row, lo, bytes)."""
    idx, start, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    lo = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    for s in W.slices(batch.column(3)):
        size = np.diff(s.bounds)
        n = np.maximum(size - length + 1, 0)
        i = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        begin = s.bounds[i] + k
        idx.append(i + s.first)
        start.append(lo[i + s.first] + k)
        hashes.append(W.range_hash(W.prefix_sums(s.data), begin, begin + length))
    return np.concatenate(idx), np.concatenate(start), np.concatenate(hashes)


def repeated_prefixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the strings that occur at two places among the contexts of
    one name. Whole names only: all contexts of a name are in the batch."""
    idx, start, h = _prefixes(batch, length)
    if len(idx) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    name = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    rows = batch.column(1).to_numpy(zero_copy_only=False)
    key = W.finalize(h ^ name[idx])
    place = (np.unique(rows, return_inverse=True)[1].astype(np.int64)[idx] << 32) | start
    order = np.argsort(key)
    key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    twice = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
    hit = order[np.repeat(twice, np.diff(np.append(first, len(key))))]
    return rows[idx[hit]], start[hit]


def _spans(rows: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Strings at the given starts as joined spans per row."""
    if len(rows) == 0:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["row", "s", "e"])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return pa.RecordBatch.from_arrays([pa.array(rows[first].astype(np.int64)), pa.array(starts[first].astype(np.int32)),
                                       pa.array((starts[last] + length).astype(np.int32))], ["row", "s", "e"])


def _compare_names(batches: Iterator[pa.RecordBatch], length: int, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """A partition sorted by name: whole names at a time, some ``most`` contexts."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        at = 0
        name = table.column(0).to_numpy()
        # the last name may go on in the next batch
        whole = int(np.searchsorted(name, name[-1], "left")) if len(name) else 0
        while at < whole:
            to = whole if whole - at <= most else int(np.searchsorted(name, name[at + most], "left"))
            to = to if to > at else int(np.searchsorted(name, name[at], "right"))
            (part,) = table.slice(at, to - at).combine_chunks().to_batches()
            yield _spans(*repeated_prefixes(part, length), length)
            at = to
        left = table.slice(whole).combine_chunks().to_batches()
        rest = left[0] if left else None
    if rest is not None and rest.num_rows:
        yield _spans(*repeated_prefixes(rest, length), length)


def _single_prefixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx, start, h = _prefixes(batch, length)
        rows = batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows[idx]), pa.array(start.astype(np.int32))],
                                         ["prefix", "row", "start"])


def _only(rows: DataFrame, found: DataFrame, how: str, broadcast_rows: int) -> DataFrame:
    """The rows whose name is (left_semi) or is not (left_anti) among ``found``. Only the
    names, 8 bytes each, are broadcast, and only if they are few (counted); so the texts
    that a later join shuffles are those it needs."""
    names = found.select(F.col("o_row").alias("n_row"))
    if found.count() <= broadcast_rows:
        names = F.broadcast(names)
    return rows.join(names, F.col("row") == F.col("n_row"), how)


def joined_spans(spans):
    """Sorted (s, e) spans with those that meet joined."""
    start = F.struct(F.array().cast(SPAN_TYPE).alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def closed(a):
        return F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    def add(a, x):
        meets = (a["e"] >= 0) & (x["s"] <= a["e"])
        return F.when(meets, F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"))).otherwise(
            F.struct(closed(a).alias("done"), x["s"].alias("s"), x["e"].alias("e")))

    return F.aggregate(F.array_sort(spans), start, add, closed)


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, crowd: int = 1000,
                   broadcast_rows: int = 500_000) -> DataFrame:
    """(row, s, e): byte spans of repeated strings, not yet joined; ``row`` is
    row_name(doc_id, text)."""
    rows = docs.select(row_name(F.col("doc_id"), whole_text()).alias("row"), whole_text().alias("text"))
    samples = written(rows.mapInArrow(partial(_sample_batches, length=length, core=core),
                                      "row long, at int, lo int, hi int, name long, triple long"), "samples")
    # names that occur once, nearly all of them, leave here; the others are a table, so
    # the join is one of two plain exchanges, which can be split at a common name
    names = written(samples.groupBy(F.col("name").alias("o_name")).agg(F.count(F.lit(1)).alias("total")).filter(
        "total > 1").select("o_name"), "repeated-names")
    flagged = written(samples.join(names, F.col("name") == F.col("o_name"), "left_semi"), "names")
    # first() of several columns takes them from one row
    triples = written(flagged.groupBy("name", "triple").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"),
                                                            F.first("at").alias("at")), "triples")
    kinds = triples.groupBy(F.col("name").alias("o_name")).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # step 3: equal triples
    equal = triples.filter("n > 1").select(F.col("name").alias("o_name"), F.col("triple").alias("o_triple"))
    settled = flagged.join(equal, (F.col("name") == F.col("o_name")) & (F.col("triple") == F.col("o_triple")), "left_semi").filter(
        F.col("hi") - F.col("lo") >= length).select("row", F.col("lo").alias("s"), F.col("hi").alias("e"))
    # step 4: one sample of every triple of a core that has several
    open_ = written(triples.join(kinds, F.col("name") == F.col("o_name")).groupBy(F.col("row").alias("o_row")).agg(
        F.collect_list(F.struct("name", "at")).alias("samples")), "open")
    around = _only(rows, open_, "left_semi", broadcast_rows).join(open_, F.col("row") == F.col("o_row"))
    contexts = around.select("row", "text", "samples").mapInArrow(
        partial(_cut_contexts, length=length, core=core), "name long, row long, lo int, bytes binary")
    crowded = kinds.filter(F.col("kinds") > crowd).select(F.col("o_name").alias("c_name"))
    contexts = written(contexts.join(crowded, F.col("name") == F.col("c_name"), "left").select(
        "name", "row", "lo", "bytes", F.col("c_name").isNotNull().alias("hot")), "contexts")
    few = contexts.filter("not hot").select("name", "row", "lo", "bytes").repartition("name").sortWithinPartitions(
        "name").mapInArrow(partial(_compare_names, length=length), "row long, s int, e int")
    single = contexts.filter("hot").select("name", "row", "lo", "bytes").mapInArrow(
        partial(_single_prefixes, length=length), "prefix long, row long, start int")
    places = single.groupBy("prefix").agg(F.min(F.struct("row", "start")).alias("a"), F.max(F.struct("row", "start")).alias("b"))
    twice = places.filter("a <> b").select(F.col("prefix").alias("o_prefix"))
    many = single.join(twice, F.col("prefix") == F.col("o_prefix"), "left_semi").select(
        "row", F.col("start").alias("s"), (F.col("start") + length).alias("e")).distinct()
    return settled.unionByName(few).unionByName(many)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, n_spans, digests = [], [], []
        for text, spans in zip(batch.column(2), batch.column(3), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            pairs = spans.as_py()
            kept, at, gone, joined = hashlib.sha256(), 0, 0, 0
            end = -1
            for x in sorted((p["s"], p["e"]) for p in pairs or ()):
                if x[0] > end:
                    kept.update(raw[at:x[0]])
                    joined += 1
                    gone += x[1] - x[0]
                    end = x[1]
                elif x[1] > end:
                    gone += x[1] - end
                    end = x[1]
                at = end
            kept.update(raw[at:])
            removed.append(gone)
            n_spans.append(joined)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                          pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, broadcast_rows: int = 500_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (joined removed
    runs) and kept_sha256 of the bytes that are left."""
    text = whole_text()
    rows = docs.select("doc_id", row_name(F.col("doc_id"), text).alias("row"), text.alias("text"))
    spans = written(repeated_spans(docs, length, core, broadcast_rows=broadcast_rows).groupBy(F.col("row").alias("o_row")).agg(
        joined_spans(F.collect_set(F.struct("s", "e"))).alias("spans")), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    touched = _only(rows, spans, "left_semi", broadcast_rows).join(spans, F.col("row") == F.col("o_row")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "spans").mapInArrow(
            _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = _only(rows, spans, "left_anti", broadcast_rows).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return whole.unionByName(touched)
