"""Integer vectors from a column of arrays, and the exact arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Squared distances of vectors within this range, and their transforms, fit 64 bits.
LIMIT = 1 << 24


def is_whole(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & F.coalesce(finite, F.lit(False))


def whole_vectors(rows: DataFrame, dims: int, scale: int, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """The ``keep`` columns and v, floor(scale * component) as long, of the rows whose
    vector is whole. Other columns are not read."""
    vector = F.col(f"`{column}`").cast("array<double>")
    return rows.filter(is_whole(vector, dims)).select(
        *[F.col(f"`{c}`") for c in keep], F.transform(vector, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column as rows of int64; components out of range are an error."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)
    if m.size and (m.max() > LIMIT or m.min() < -LIMIT):
        raise ValueError(f"a scaled component lies outside +-{LIMIT}: its distances would not fit 64 bits")
    return m


def floor_means(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count)."""
    return sums // counts[:, None]
