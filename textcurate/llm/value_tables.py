"""Product codes of integer vectors, with distances looked up by value dictionaries.

A vector is cut into equal consecutive parts, each part position with a codebook of its
own. A component is an integer, and few integers occur per dimension. So, for some vectors
at a time, a dictionary of the distinct integers of each dimension is made, and for each of
them the squared differences to all entries of the codebook are tabulated once. The
distances of a part to all entries are then rows gathered by dictionary code and added up:
no subtraction or product per vector. Integers all the way, so results are exact.

A round is one pass of tasks over the stored vectors. A task returns at most one row per
part and entry (count and sums), Spark adds these up, and the driver holds only the
codebooks, whose size the parameters bound.

Cases: a vector that is null, of another length, or with a null, NaN or infinite component
takes no part. A component beyond 2**24 after scaling is an error. Repeated rows are
vectors of their own. Null ids sort last, equal ids by vector, when the first entries are
chosen; with fewer vectors than entries the codebooks are as short as that. Equal distances
go to the lower entry. Null labels are one label. Of an empty table the result is empty.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import floor_means, matrix, whole_vectors

DICTIONARY_ROWS = 8192  # vectors that share dictionaries
GATHER_ROWS = 512  # vectors whose distances are held at a time


def difference_table(values: np.ndarray, entries: np.ndarray, kind: type) -> np.ndarray:
    """Squared difference of every dictionary value to one component of every entry."""
    d = values[:, None] - entries[None, :]
    return (d * d).astype(kind)


def nearest_entries(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest codebook entry for every row of ``part``."""
    span = max(int(part.max()), int(book.max())) - min(int(part.min()), int(book.min()))
    kind = np.int32 if span * span * part.shape[1] < 2 ** 31 else np.int64
    codes, tables = [], []
    for d in range(part.shape[1]):
        values, code = np.unique(part[:, d], return_inverse=True)
        codes.append(code)
        tables.append(difference_table(values, book[:, d], kind))
    entry, distance = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for at in range(0, len(part), GATHER_ROWS):
        rows = slice(at, at + GATHER_ROWS)
        total = tables[0][codes[0][rows]]
        for table, code in zip(tables[1:], codes[1:], strict=True):
            total += table[code[rows]]
        entry[rows] = total.argmin(axis=1)
        distance[rows] = total[np.arange(len(total)), entry[rows]]
    return entry, distance


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """(batch rows, parts, entries, distances) with shapes (n, parts, width), (n, parts), (n, parts)."""
    n_parts, _, width = books.shape
    for whole in batches:
        for at in range(0, len(whole), DICTIONARY_ROWS):
            batch = whole.slice(at, DICTIONARY_ROWS)
            parts = matrix(batch.column("v"), n_parts * width).reshape(-1, n_parts, width)
            found = [nearest_entries(parts[:, p], books[p]) for p in range(n_parts)]
            yield batch, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per part and entry of what the task assigned to it."""
    n_parts, size, width = books.shape
    count, total = np.zeros(n_parts * size, np.int64), np.zeros((n_parts * size, width), np.int64)
    for _, parts, entry, _ in _coded(batches, books):
        place = (entry + np.arange(n_parts) * size).ravel()
        count += np.bincount(place, minlength=n_parts * size)
        np.add.at(total, place, parts.reshape(-1, width))
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                     ["place", "n", "total"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, _, entry, distance in _coded(batches, books):
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([row.astype(np.uint8).tobytes().hex() for row in entry], pa.string()),
             pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])


def first_books(vectors: DataFrame, n_parts: int, size: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(size).collect()
    width = len(rows[0]["v"]) // n_parts if rows else 0
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), n_parts, width).transpose(1, 0, 2).copy()


def next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every used entry moves to the floor of the mean of its parts."""
    n_parts, size, width = books.shape
    found = vectors.mapInArrow(partial(_sums, books=books), "place int, n long, total array<long>")
    added = found.groupBy("place").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect()
    flat = books.reshape(-1, width).copy()
    if added:  # at most one row per entry
        at = np.array([r["place"] for r in added])
        flat[at] = floor_means(np.array([r["total"] for r in added], np.int64), np.array([r["n"] for r in added], np.int64))
    return flat.reshape(books.shape)


def compress(rows: DataFrame, n_parts: int = 4, size: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector is
    whole. ``size`` is at most 256: an index is one byte."""
    if dims % n_parts or not 0 < size <= 256:
        raise ValueError("dims must be a multiple of n_parts, and size from 1 to 256")
    vectors = written(whole_vectors(rows, dims, scale, ("vec_id", "label")), "parts")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    books = first_books(vectors, n_parts, size)
    for _ in range(rounds if books.size else 0):
        books = next_books(vectors, books)
    found = written(vectors.mapInArrow(partial(_codes, books=books),
                                       f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    # a table of its own: its size is known when the join is planned, and AQE splits a hot label
    labels = written(found.groupBy(F.col("label").alias("l_label")).agg(F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return found.join(labels, F.col("label").eqNullSafe(F.col("l_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
