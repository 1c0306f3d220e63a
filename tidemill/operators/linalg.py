"""Least squares for many keys at once: cross-products are a distributed aggregate,
only the fixed-size solves run in Arrow batches, many keys per call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import dbl, let

VECTOR = T.ArrayType(T.DoubleType())


def gram(columns: Sequence[Column], where: Column) -> Column:
    """Aggregate: upper triangle of the cross-products of ``columns``, summed over the rows in ``where``.

    Put the target last. One vector sum per key instead of k(k+1)/2 scalar sums
    keeps the generated code small whatever the number of columns.
    """
    k = len(columns)
    usable = F.coalesce(where, F.lit(False))
    row = F.array(*[F.when(usable, F.coalesce(c, dbl(0.0))).otherwise(dbl(0.0)) for c in columns])

    def triangle(xs: Column) -> Column:
        return F.flatten(F.transform(xs, lambda a, i: F.transform(F.slice(xs, i + 1, k), lambda b: a * b)))

    return vector_to_array(Summarizer.sum(array_to_vector(let(row, triangle))))


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    """(batch, k(k+1)/2) triangles to (batch, k, k) symmetric matrices."""
    full = np.zeros((len(flat), k, k))
    a, b = np.triu_indices(k)
    full[:, a, b] = flat
    full[:, b, a] = flat
    return full


def stack(series: pd.Series, width: int) -> np.ndarray:
    """Arrays of a batch as one matrix; rows with nulls or the wrong size become NaN."""
    out = np.full((len(series), width), np.nan)
    for row, values in enumerate(series):
        if values is not None and len(values) == width:
            out[row] = np.asarray(values, dtype=float)
    return out


def solve_batch(xx: np.ndarray, xy: np.ndarray, ridge: np.ndarray | float = 1e-10) -> np.ndarray:
    """Solves every system of a batch; ridge is relative to the diagonal unless given per column.

    Keys whose system holds NaN (no usable rows) get NaN coefficients.
    """
    k = xx.shape[1]
    diagonal = np.einsum("bii->bi", xx)
    extra = diagonal * ridge + 1e-12 if np.isscalar(ridge) else np.broadcast_to(ridge, diagonal.shape)
    system = xx + extra[:, :, None] * np.eye(k)
    bad = ~np.isfinite(system).all(axis=(1, 2)) | ~np.isfinite(xy).all(axis=1)
    system[bad] = np.eye(k)
    result = np.linalg.solve(system, np.where(bad[:, None], 0.0, xy)[:, :, None])[:, :, 0]
    result[bad] = np.nan
    return result


def as_lists(rows: np.ndarray) -> pd.Series:
    return pd.Series([None if np.isnan(row).any() else row.tolist() for row in rows], dtype=object)


def least_squares(k: int, ridge: Sequence[float] | float = 1e-10) -> Callable[[Column], Column]:
    """Column function: gram array of k regressors and the target -> coefficient array (null if unsolvable)."""
    penalty = ridge if np.isscalar(ridge) else np.asarray(ridge, dtype=float)

    @F.pandas_udf(VECTOR)
    def solve(grams: pd.Series) -> pd.Series:
        full = unpack(stack(grams, (k + 1) * (k + 2) // 2), k + 1)
        return as_lists(solve_batch(full[:, :k, :k].copy(), full[:, :k, k], penalty))

    return solve
