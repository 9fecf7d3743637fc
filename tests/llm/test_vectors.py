"""Centroid clustering and product codes against plain Python, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.llm import value_tables, walsh_kmeans

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def made(seed, n, dims=64, spread=0.3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


def edge_rows():
    rows = made(1, 330)
    rows += [(1000 + i, rows[7][1], 3) for i in range(150)]  # copies: ties, and one group of many
    rows += [(1000, rows[7][1], 3), (5, rows[5][1], 0), (None, rows[3][1], None), (9, rows[4][1], 1)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.5] * 63, 0), (2003, [0.5] * 65, 0), (2004, [*rows[1][1][:63], None], 0),
             (2005, [*rows[1][1][:63], math.nan], 0), (2006, [*rows[1][1][:63], -math.inf], 1), (2007, [-0.0] * 64, 1), (2008, [-1e-9] * 64, 1)]
    return rows


def whole(rows, scale, dims):
    return [(i, tuple(math.floor(scale * x) for x in v), lab) for i, v, lab in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def best(v, entries):
    return min((squared(v, e), i) for i, e in enumerate(entries))


def moved(entries, vectors, chosen):
    out = []
    for i, e in enumerate(entries):
        mine = [v for v, c in zip(vectors, chosen, strict=True) if c == i]
        out.append(tuple(sum(xs) // len(mine) for xs in zip(*mine, strict=True)) if mine else e)
    return out


def sha(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def brute_clusters(rows, k, rounds, dims=64):
    kept = whole(rows, 256, dims)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [r[1] for r in order[:k]]
    vectors = [r[1] for r in kept]
    for _ in range(rounds):
        c = moved(c, vectors, [best(v, c)[1] for v in vectors])
    found = [best(v, c) for v in vectors]
    per = [sum(d for d, j in found if j == i) for i in range(len(c))]
    return sorted((str(r[0]), j, d, per[j], sum(per), sha(c[j])) for r, (d, j) in zip(kept, found, strict=True))


def brute_codes(rows, size, rounds, dims=64, parts=4):
    kept = whole(rows, 1024, dims)
    w = dims // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    found, books = [], []
    for p in range(parts):
        vectors = [r[1][p * w:(p + 1) * w] for r in kept]
        b = [r[1][p * w:(p + 1) * w] for r in first]
        for _ in range(rounds):
            b = moved(b, vectors, [best(v, b)[1] for v in vectors])
        books.append(b)
        found.append([best(v, b) for v in vectors])
    rowwise = list(zip(*found, strict=True))
    errors = [sum(d for d, _ in f) for f in rowwise]
    label = {}
    for r, e in zip(kept, errors, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    digest = sha([x for b in books for e in b for x in e])
    return sorted((str(r[0]), "".join(f"{j:02x}" for _, j in f), e, label[r[2]], digest) for r, f, e in zip(kept, rowwise, errors, strict=True))


def table(spark, rows, parts=3):
    """The rows with other columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in ("v", "cluster", "distance", "c_cluster", "inertia", "n", "total", "place", "code", "error", "l_label", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


def got(df, *columns):
    return sorted((str(r["vec_id"]), *(r[c] for c in columns)) for r in df.collect())


CLUSTER = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
CODE = ("code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("parts", [1, 7])
def test_clusters(spark, parts):
    rows = edge_rows()
    assert got(walsh_kmeans.cluster(table(spark, rows, parts), k=40, rounds=5), *CLUSTER) == brute_clusters(rows, 40, 5)


@pytest.mark.parametrize("parts", [1, 7])
def test_codes(spark, parts):
    rows = edge_rows()
    assert got(value_tables.compress(table(spark, rows, parts), size=256, rounds=4), *CODE) == brute_codes(rows, 256, 4)


def test_few_vectors(spark):
    """Fewer vectors than clusters or entries, all of them alike or not."""
    for rows in (made(2, 3), [(1, [0.25] * 64, None)] * 5):
        assert got(walsh_kmeans.cluster(table(spark, rows)), *CLUSTER) == brute_clusters(rows, 40, 5)
        assert got(value_tables.compress(table(spark, rows)), *CODE) == brute_codes(rows, 256, 4)


def test_other_sizes(spark):
    """A number of components that is no power of two, large and negative values."""
    rows = [(i, [float(np.float32(300 * x)) for x in v], lab) for i, v, lab in made(3, 60, dims=12)]
    assert got(walsh_kmeans.cluster(table(spark, rows), k=5, rounds=2, dims=12), *CLUSTER) == brute_clusters(rows, 5, 2, 12)
    assert got(value_tables.compress(table(spark, rows), size=9, rounds=2, dims=12), *CODE) == brute_codes(rows, 9, 2, 12)


def test_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 2)]):
        assert walsh_kmeans.cluster(table(spark, rows)).count() == 0
        assert value_tables.compress(table(spark, rows)).count() == 0


def test_too_large(spark):
    rows = [*made(4, 3), (9, [1e6] * 64, 0)]
    for run in (walsh_kmeans.cluster, value_tables.compress):
        with pytest.raises(Exception, match="scaled component"):
            run(table(spark, rows)).count()


def test_transform():
    """Orthogonal, integer, coarse first; distances up to the factor n."""
    h = walsh_kmeans.walsh_hadamard(np.eye(16, dtype=np.int64)).T
    assert (h @ h.T == 16 * np.eye(16, dtype=np.int64)).all() and set(np.unique(h)) == {-1, 1}
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(16))
    x = np.random.default_rng(1).integers(-1000, 1000, (2, 16))
    y = walsh_kmeans.walsh_hadamard(x)
    assert ((y[0] - y[1]) ** 2).sum() == 16 * ((x[0] - x[1]) ** 2).sum()


@pytest.mark.parametrize("block", [1, 8, 64])
def test_progressive_search(block):
    """Any block size finds the nearest, ties included."""
    rng = np.random.default_rng(block)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (30, 64))
    c[11] = c[4]
    x[:40] = c[rng.integers(0, 30, 40)]
    number, distance = walsh_kmeans.nearest(walsh_kmeans.walsh_hadamard(x), walsh_kmeans.walsh_hadamard(c), block)
    full = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_value_dictionaries():
    """Narrow and wide integers give the distances of subtraction and product."""
    rng = np.random.default_rng(5)
    for bound in (4, 2000, 1 << 24):
        part, book = rng.integers(-bound, bound, (700, 16)), rng.integers(-bound, bound, (20, 16))
        book[9] = book[2]
        entry, distance = value_tables.nearest_entries(part, book)
        full = ((part[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()
