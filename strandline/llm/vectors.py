"""What the two vector operators share: which vectors take part, classes of equal vectors, and columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embedding="embedding"):
    """A vector that takes part: not null, not empty, all components finite, some component not zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def lengths(vectors: DataFrame) -> list[int]:
    """The lengths that occur; vectors are compared with those of their own length only, so each length is a job of its own."""
    return sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect())


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    """A list column of equal lengths as [rows, length]."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(dtype, copy=False) if n else np.zeros((0, 0), dtype)


def parts(keys: np.ndarray):
    """(start, end) of each run of equal keys."""
    if not len(keys):
        return []
    cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cut[:-1], cut[1:]))
