"""K-RANK: exact, distributed row numbers.

``row_number()`` over an unpartitioned window (or over three labels) puts all
(or a third) of the rows into one task. Here the sort key is first mapped to a
bucket that is monotone in the sort order; per-(group, bucket) counts form a
small table whose prefix sums give each bucket's offset; the row number is the
offset plus ``row_number()`` inside one (group, bucket). Every window therefore
holds about n / n_buckets rows, and the result equals the single-window
``row_number`` exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions.labels import hex_prefix_int

# Fixed value: hash-ordered keys are bucketed on their first 4 hex digits.
HEX_BUCKET_DIGITS = 4  # 65 536 buckets


def hex_bucket(hex_col: Column, digits: int = HEX_BUCKET_DIGITS) -> Column:
    """Bucket of an md5-hex sort key: uniform, and monotone in the key."""
    return hex_prefix_int(hex_col, digits)


# Rows that a bucket of a ranged key is meant to hold; none of distinct keys holds
# more than twice as many.
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 16


def bucket_count(n_rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets grow with the rows, so a bucket (one task's window) does not."""
    return max(LEAST_BUCKETS, -(-n_rows // bucket_rows))


def range_bucket(df: DataFrame, col: str, out: str = "_bucket", bounds_from: DataFrame | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Bucket a numeric sort key by approximate quantiles (a distributed sketch; only
    the boundaries reach the driver). Monotone in the key whatever the quantile
    error, so ranks stay exact. There are n / ``bucket_rows`` buckets and the error
    is a quarter of a bucket at either bound, so the largest holds at most 1.5 x
    ``bucket_rows`` distinct keys. Null keys get a null bucket. ``bounds_from`` may
    supply a cheap superset relation of the key (e.g. the source id column) so a
    costly upstream plan is not run twice."""
    src = (bounds_from if bounds_from is not None else df).select(col)
    n_buckets = bucket_count(src.count(), bucket_rows)
    bounds = src.approxQuantile(col, [i / n_buckets for i in range(1, n_buckets)], 1 / (4 * n_buckets))
    splits = [float("-inf")] + sorted({float(b) for b in bounds if b is not None}) + [float("inf")]
    tmp = f"{out}_src"
    staged = df.withColumn(tmp, F.col(col).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol=tmp, outputCol=out,
                          handleInvalid="keep").transform(staged)
    return bucketed.withColumn(out, F.col(out).cast("long")).drop(tmp)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    on = None
    for k in keys:
        c = left[k].eqNullSafe(named[f"_ns_{k}"])
        on = c if on is None else on & c
    return left.join(named, on, how).drop(*[f"_ns_{k}" for k in keys])


def row_number_exact(df: DataFrame, order: Sequence[Column], bucket: Column,
                     partition: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """1-based row number over ``partition`` ordered by ``order``.

    ``bucket`` must be non-decreasing along ``order`` within a partition, nulls
    first. Null partition values form a group and null keys rank first: no row is
    lost. The offset table has a row per group and bucket; whether it is broadcast
    is left to its runtime size.
    """
    part = list(partition)
    b = "_rk_bucket"
    staged = df.withColumn(b, bucket)
    counts = staged.groupBy(*part, b).agg(F.count(F.lit(1)).alias("_rk_n"))
    w_off = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0)))
    w_off = w_off.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, b, F.coalesce(F.sum("_rk_n").over(w_off), F.lit(0))
                            .cast("long").alias("_rk_off"))
    joined = join_null_safe(staged, offsets, part + [b])
    w = Window.partitionBy(*[F.col(c) for c in part], F.col(b)).orderBy(*order)
    return (joined.withColumn(out, (F.col("_rk_off") + F.row_number().over(w)).cast("long"))
            .drop(b, "_rk_off"))
