"""Vectors of the embeddings table as exact whole numbers, in blocks that numpy can work on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magnitude below which whole numbers are kept as 64-bit integers; larger ones are Python's.
SMALL = 1 << 62


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: Column) -> Column:
    """Whether a vector is given and all its components are, and are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def whole(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each component of a list column without nulls, rows by dims; shorter vectors end in zeros.

    Numbers that a 64-bit integer can't hold are Python's, in an array of objects.
    """
    lengths = np.diff(column.offsets.to_numpy())
    given = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.floor(given * scale)
    if len(flat) and np.abs(flat).max() >= SMALL:
        flat = np.array([int(f) if np.isfinite(f) else int(x) * scale for f, x in zip(flat, given)], object)
    else:
        flat = flat.astype(np.int64)
    out = np.zeros((len(lengths), dims), flat.dtype)
    if len(flat):
        out[np.arange(dims) < lengths[:, None]] = flat
    return out


def largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def exact(bound: int, *values: np.ndarray) -> list[np.ndarray]:
    """The arrays in the quickest kind of number in which results up to `bound` are exact."""
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < SMALL else object
    return [x.astype(kind) if x.dtype != kind else x for x in values]
