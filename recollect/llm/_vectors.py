"""Vectors from Arrow list columns, checked and in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vec: str) -> Column:
    """True for a vector that is not null, empty or zero and holds no null or non-finite component."""
    c = F.col(vec)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame, vec: str) -> Column:
    return F.col(vec).cast(T.ArrayType(T.DoubleType()))


def reals(df: DataFrame, vec: str) -> Column:
    """Floats where the column holds floats, else doubles; every zero without a sign."""
    kind = df.schema[vec].dataType
    kind = T.FloatType() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    return F.transform(F.col(vec).cast(T.ArrayType(kind)), lambda x: x + F.lit(0.0).cast(kind))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    n = len(col)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def rows(m: np.ndarray) -> pa.Array:
    """A matrix as a column of lists of doubles."""
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)[: len(m) + 1], pa.array(m.ravel()))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, each always summed in the same order."""
    return np.einsum("ij,ij->i", a, b)
