"""k-means over integer vectors with a progressive search on Walsh-Hadamard coefficients.

The transform H (entries +1 and -1, rows by number of sign changes) keeps squared
distances up to a factor: |Hx - Hc|**2 = n |x - c|**2 over n components, in integers and
without rounding. Its first coefficients hold the coarse shape of a vector. The search
adds squared coefficient differences from coarse to fine. A partial sum never falls, so a
centroid whose partial sum exceeds the whole distance of any one centroid is strictly
worse and is dropped; those left after the last coefficient have their exact distances.

Every round is one pass of tasks over the stored vectors. A task returns one row per
centroid (count and sums), Spark adds these up by centroid, and the driver holds only the
centroids. So a hot cluster costs no task more than its own rows.

Cases: a vector that is null, of another length, or with a null, NaN or infinite component
takes no part. A component beyond 2**24 after scaling is an error, as its distances would
not fit a long. Repeated rows are vectors of their own. A null id sorts last as a first
centroid. With fewer vectors than clusters there are as many centroids as vectors; of an
empty table the result is empty. Equal distances go to the smaller number. Other columns
are not read, whatever their names.
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

ROWS = 1024  # vectors searched at a time
BLOCK = 8  # coefficients added between two eliminations


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Integer transform of every row, coarse coefficients first. Rows are filled up
    with zeros to a power of two, which changes no distance."""
    n = 1 << max(x.shape[1] - 1, 0).bit_length()
    y = np.zeros((len(x), n), np.int64)
    y[:, :x.shape[1]] = x
    return _butterflies(y)[:, _sequency(n)]


def _butterflies(y: np.ndarray) -> np.ndarray:
    rows, n = y.shape
    half = 1
    while half < n:
        pairs = y.reshape(rows, n // (2 * half), 2, half)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return y


def _sequency(n: int) -> np.ndarray:
    """Order of the coefficients by the sign changes of their basis row."""
    basis = _butterflies(np.eye(n, dtype=np.int64)).T
    return np.argsort((np.diff(basis, axis=1) != 0).sum(axis=1), kind="stable")


def nearest(x: np.ndarray, c: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest row of c for every row of x; both are
    transforms. Equal distances go to the smaller number."""
    n = x.shape[1]
    each = np.arange(len(x))
    partial_sum = _squares(x[:, None, :block] - c[None, :, :block])
    leader = partial_sum.argmin(axis=1)
    whole = partial_sum[each, leader] + _squares(x[:, block:] - c[leader, block:])
    row, number = np.nonzero(partial_sum <= whole[:, None])
    so_far = partial_sum[row, number]
    for at in range(block, n, block):
        so_far = so_far + _squares(x[row, at:at + block] - c[number, at:at + block])
        stays = so_far <= whole[row]
        row, number, so_far = row[stays], number[stays], so_far[stays]
    # pairs are ordered by row, then number, and every row has its leader at least
    least = np.minimum.reduceat(so_far, np.searchsorted(row, each)) if len(x) else np.empty(0, np.int64)
    hit = np.flatnonzero(so_far == least[row])
    first = hit[np.searchsorted(row[hit], each)]
    return number[first], least // n


def _squares(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=-1)


def _searched(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, numbers, distances) of some vectors at a time."""
    c = walsh_hadamard(centroids)
    for batch in batches:
        v = matrix(batch.column(1), centroids.shape[1])
        for at in range(0, len(v), ROWS):
            rows = v[at:at + ROWS]
            yield batch.column(0).slice(at, len(rows)), rows, *nearest(walsh_hadamard(rows), c)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per centroid of what the task assigned to it."""
    k, dims = centroids.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for _, rows, number, _ in _searched(batches, centroids):
        count += np.bincount(number, minlength=k)
        np.add.at(total, number, rows)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                     ["cluster", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, _, number, distance in _searched(batches, centroids):
        yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest salted hash of their id, in its order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(key.asc_nulls_last(), "v").select("v").limit(k).collect()], np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors moves to the floor of their mean."""
    k, dims = centroids.shape
    found = vectors.select("vec_id", "v").mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, total array<long>")
    added = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()
    moved = centroids.copy()
    if added:  # at most k rows
        at = np.array([r["cluster"] for r in added])
        moved[at] = floor_means(np.array([r["total"] for r in added], np.int64), np.array([r["n"] for r in added], np.int64))
    return moved


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every
    row whose vector is whole."""
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, dims, scale), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(vectors, centroids)
    found = written(vectors.select("vec_id", "v").mapInArrow(partial(_assigned, centroids=centroids),
                                                            f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    sums = [(i, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in inertia.items()]
    table = spark.createDataFrame(sums, "c_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), F.col("cluster") == F.col("c_cluster")).drop("c_cluster")
