"""Shared by the operators on embeddings: which rows take part, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id


def usable(rows: DataFrame, id_col: str, vec_col: str, *more: str) -> tuple[DataFrame, int]:
    """(i, v, more...) of the rows whose vector takes part, and its length.

    Vectors that are null or zero, hold null or non-finite components, or are not of the most common length
    (the least of equals) take no part.
    """
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return common_length(rows.select(row_id(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v"), *more).where(F.coalesce(ok, F.lit(False))))


def common_length(found: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vector v is of the most common length (the least of equals), and that length."""
    sizes = sorted(((-r.n, r.d) for r in found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()))  # lengths
    d = sizes[0][1] if sizes else 0
    return found.where(F.size("v") == d), d


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))
