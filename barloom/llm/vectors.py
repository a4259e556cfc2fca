"""Embedding columns as vectors of integers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scaled components stay below this, so that sums of squares over thousands of components fit 64 bits.
LARGEST = 1 << 24


def usable(v: Column, scale: int) -> Column:
    """Whether a vector is there and holds neither nulls nor components that are not finite or, scaled, ``LARGEST`` or more."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= LARGEST))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """row (place in ``df``), id, v: every component x as floor(scale * x), of usable vectors with ``dims`` components (any number: None)."""
    d = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fits = usable(F.col("x"), scale)
    if dims is not None:
        fits = fits & (F.size("x") == dims)
    return d.where(fits).select("row", "id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of 64-bit integers; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    return out
