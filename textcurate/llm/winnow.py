"""Benchmark decontamination by winnowing.

Both sides are cut into lower-cased words. Of every run of ``span`` consecutive
words the smallest k-gram hash is kept (with k = 5 and span = 13 that is the
minimum of 9 neighbouring hashes; ties keep all). The choice depends only on the
words of the run, so a run shared by a document and an item leaves the same
fingerprint at the same place of both: joining the fingerprints finds every shared
run of at least ``span`` words. Items shorter than that are one window of their
own length n and get their own class of fingerprints, chosen over runs of n words.

Each hit fixes a diagonal (document position less item position). The document's
and the item's words are compared along it, and every maximal equal run that is
long enough marks its words. So hash collisions never show in the result.

The benchmark's fingerprints are counted. Up to ``filter_size`` of them, the tasks
that hash the documents drop fingerprints that no item has, before the join; above
that all fingerprints are joined. Both ways give the same rows. The texts of the
documents with hits are read again; the hits are broadcast only if their counted
rows are few, else joined.

Defined cases: a null or empty text has no words, no hits, and is clean; an item
without words matches nothing; repeated items count once, repeated documents get
equal results; a null item_id counts as the text "" in the digest; empty tables
give empty or clean results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.session import cut_lineage

from . import wordhash as W
from .common import same_row, text_key, whole_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HIGHEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over x[j : j + size] for every j; the result is size - 1 shorter."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def selected(word_hash: np.ndarray, n_words: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the slice) and hashes of the k-grams that are the smallest of
    some run of ``span`` words inside one document."""
    width = span - k + 1
    grams = W.windows(word_hash, k)
    n = len(grams) - width + 1  # runs
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.minimum(grams, HIGHEST - np.uint64(1)) + np.uint64(1)  # never 0
    least = slide(grams, width, np.minimum)
    doc_end = np.repeat(np.cumsum(n_words), n_words)[:n]
    least[np.arange(n) + span > doc_end] = 0  # runs that cross a document's end
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[width - 1:width - 1 + n] = least
    at = np.flatnonzero(slide(padded, width, np.maximum) == grams)
    return at, grams[at]


def _tag(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of one class never equal those of another."""
    return W.finalize(h ^ np.uint64(length * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def classes(lengths: list[int], k: int, span: int) -> list[tuple[int, int]]:
    """(k, run) of each class: the common one, and one per short item length."""
    return [(k, span)] + [(min(k, n), n) for n in sorted(lengths) if n < span]


def _doc_fingerprints(batches: Iterator[pa.RecordBatch], kinds, wanted) -> Iterator[pa.RecordBatch]:
    keep = wanted.value if wanted is not None else None
    for batch in batches:
        for s in W.slices(batch.column(2)):
            word_hash, n_words, _, _ = W.hashed_words(s, W.NON_ALNUM)
            first = np.cumsum(n_words) - n_words
            at, fp = [], []
            for k, span in kinds:
                p, h = selected(word_hash, n_words, k, span)
                h = _tag(h, span)
                if keep is not None and len(keep):
                    i = np.searchsorted(keep, h)
                    found = keep[np.minimum(i, len(keep) - 1)] == h
                    p, h = p[found], h[found]
                at.append(p)
                fp.append(h)
            at, fp = np.concatenate(at), np.concatenate(fp)
            order = np.argsort(at, kind="stable")
            at, fp = at[order], fp[order]
            doc = np.searchsorted(first + n_words, at, "right")
            per_doc = np.searchsorted(doc, np.arange(len(n_words) + 1)).astype(np.int32)
            n = len(n_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.first, n), batch.column(1).slice(s.first, n), pa.array(n_words.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(per_doc), pa.array((at - first[doc]).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(per_doc), pa.array(fp))],
                ["doc_id", "text_key", "n_words", "at", "fp"])


def fingerprints(rows: DataFrame, kinds: list[tuple[int, int]], wanted=None) -> DataFrame:
    """rows(doc_id, text_key, text) -> doc_id, text_key, n_words, at, fp."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_doc_fingerprints, kinds=kinds, wanted=wanted),
                           f"doc_id {kind}, text_key long, n_words long, at array<int>, fp array<long>")


def _own_class(f: DataFrame, span: int) -> DataFrame:
    """Item fingerprints of the class of the item's own length only: an item of
    ``span`` words or more is found by the common class."""
    return f.filter((F.col("n_words") >= span) == (F.col("cls") == span)).filter(
        (F.col("cls") == span) | (F.col("cls") == F.col("n_words")))


def _extend(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, key, text, hits in zip(*(batch.column(i) for i in range(4)), strict=True):
            words = WORD.findall(text.as_py().encode("utf-8", "surrogatepass").lower())
            covered, items = bytearray(len(words)), set()
            for hit in hits.as_py():
                item = WORD.findall(hit["text"].encode("utf-8", "surrogatepass").lower())
                least = min(span, len(item))
                for diagonal in hit["diagonals"]:
                    i = max(0, -diagonal)
                    stop = min(len(item), len(words) - diagonal)
                    while i < stop:
                        if item[i] != words[diagonal + i]:
                            i += 1
                            continue
                        j = i + 1
                        while j < stop and item[j] == words[diagonal + j]:
                            j += 1
                        if j - i >= least:
                            covered[diagonal + i:diagonal + j] = b"\x01" * (j - i)
                            items.add(hit["item_id"] or "")
                        i = j
            names = sorted(items)
            out.append((doc_id.as_py(), key.as_py(), covered.count(1), names))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.list_(pa.string()))], ["doc_id", "text_key", "n_hit", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, span: int = 13,
                       filter_size: int = 2_000_000, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_words, n_hit, items (sorted ids)."""
    spark = docs.sparkSession
    item_rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole_text().alias("text")).distinct()
    item_rows = cut_lineage(item_rows.withColumn("doc_id", F.monotonically_increasing_id()).withColumn(
        "text_key", text_key(F.col("text"))))
    as_docs = item_rows.select("doc_id", "text_key", "text")
    sizes = fingerprints(as_docs, [(k, span)]).filter((F.col("n_words") > 0) & (F.col("n_words") < span))
    # at most span - 1 different lengths
    short = [r[0] for r in sizes.select("n_words").distinct().collect()]
    kinds = classes(short, k, span)
    per_class = None
    for pair in kinds:
        f = fingerprints(as_docs, [pair]).select("doc_id", "n_words", F.explode(F.arrays_zip("at", "fp")).alias("x"),
                                                 F.lit(pair[1]).alias("cls"))
        per_class = f if per_class is None else per_class.unionByName(f)
    item_fp = cut_lineage(_own_class(per_class, span).select(
        F.col("doc_id").alias("row"), F.col("x.at").alias("i_at"), F.col("x.fp").alias("i_fp")))
    few = item_fp.count() <= filter_size
    wanted = None
    if few:  # bounded by filter_size longs
        wanted = spark.sparkContext.broadcast(np.sort(np.array(
            [r[0] for r in item_fp.select("i_fp").distinct().collect()], np.int64)))
    rows = docs.select("doc_id", text_key(whole_text()).alias("text_key"), whole_text().alias("text"))
    printed = cut_lineage(fingerprints(rows, kinds, wanted))
    flat = printed.filter(F.size("fp") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.explode(F.arrays_zip("at", "fp")).alias("x"))
    hits = flat.join(F.broadcast(item_fp) if few else item_fp, F.col("x.fp") == F.col("i_fp")).groupBy(
        "doc_id", "text_key", "row").agg(F.collect_set(F.col("x.at") - F.col("i_at")).alias("diagonals"))
    texts = item_rows.select(F.col("doc_id").alias("row"), "item_id", F.col("text").alias("i_text"))
    hits = cut_lineage(hits.join(texts, "row").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(
        "item_id", F.col("i_text").alias("text"), "diagonals")).alias("hits")))
    if hits.count() <= broadcast_rows:
        hits = F.broadcast(hits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = rows.join(hits, same_row(rows, hits)).select(rows["doc_id"], rows["text_key"], "text", "hits").mapInArrow(
        partial(_extend, span=span), f"doc_id {kind}, text_key long, n_hit long, items array<string>").dropDuplicates(
            ["doc_id", "text_key"])
    return printed.join(marked, same_row(printed, marked), "left").select(
        printed["doc_id"], printed["text_key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
