"""Vectors as matrices: which rows count, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), *more).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))
