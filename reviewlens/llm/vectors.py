"""Reading vector columns: which vectors take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import col


def usable(vector: str):
    """True for vectors that are not null or empty and hold finite components only."""
    bad = F.exists(col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(col(vector)) > 0) & ~bad, F.lit(False))


def not_zero(vector: str):
    return F.exists(col(vector), lambda x: x != 0)


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column whose lists have one length and no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)
