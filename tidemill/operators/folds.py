"""Feature models over expanding folds, from one table of training rows.

Folds are nested: a row that trains fold k trains every later one. So each row carries its first fold, cross-products are summed once
per first fold, and the normal equations of fold k are the sum of those up to k: all ridge fits cost one pass. Trees are fitted per fold
on the same written table. Test rows are predicted from the values before them, as in ``model_set.backtest_predictions``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl
from tidemill.operators import ml
from tidemill.operators.linalg import VECTOR, gram, stack, unpack
from tidemill.spec import SeriesSpec


def with_folds(rows: DataFrame, n_splits: int = 5, test_size: int = 12) -> DataFrame:
    """Adds ``first_fold``, the first fold that trains on the row, and ``test_fold``, the one that tests it; null where there is none.

    Fold k tests the ``test_size`` rows that end ``test_size * (n_splits - k)`` rows before the newest, and needs two such stretches before them.
    """
    size, age = F.lit(test_size), F.col("age")
    by_age = n_splits + 1 - F.floor((age - 1) / size)
    by_length = n_splits + 3 - F.floor(F.col("n") / size)
    first = F.greatest(by_age, by_length, F.lit(1))
    test = by_age - 1
    return rows.withColumns(
        {
            "first_fold": F.when(first <= n_splits, first).cast("int"),
            "test_fold": F.when((test >= by_length) & (test >= 1) & (test <= n_splits), test).cast("int"),
        }
    )


def _ridge_solver(width: int, alpha: float):
    """Column function: cross-products of centred features, a constant and the label -> coefficients, then the intercept."""

    @F.pandas_udf(VECTOR)
    def solve(grams: pd.Series) -> pd.Series:
        out = []
        for g in unpack(stack(grams, (width + 2) * (width + 3) // 2), width + 2):
            n = g[width, width]
            mean, y = g[:width, width] / n, g[width, width + 1] / n
            cov = g[:width, :width] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
            use = sd > 1e-9 * np.maximum(np.abs(mean), 1.0)
            scaled = cov[use][:, use] / np.outer(sd[use], sd[use])
            right = (g[:width, width + 1] / n - mean * y)[use] / sd[use]
            coef = np.zeros(width)
            coef[use] = np.linalg.solve(n * scaled + alpha * np.eye(use.sum()), n * right) / sd[use]
            out.append([*coef.tolist(), float(y - coef @ mean)])
        return pd.Series(out, dtype=object)

    return solve


def ridge_by_fold(rows: DataFrame, n_splits: int = 5, alpha: float = 1.0) -> DataFrame:
    """(fold, coefficients, intercept) of every fold with training rows, from one pass over ``rows``."""
    names = ml.feature_names()
    m = len(names)
    train = rows.where(F.col("first_fold").isNotNull())
    centre = train.agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("c"), F.avg("label").alias("y")).first()
    if centre.y is None:
        return rows.sparkSession.createDataFrame([], "fold int, coefficients array<double>, intercept double")
    x = train.withColumn("_x", F.zip_with(vector_to_array("features"), F.lit(centre.c), lambda a, b: a - b))
    columns = [*(F.col("_x")[k] for k in range(m)), dbl(1.0), F.col("label") - dbl(centre.y)]
    parts = x.groupBy("first_fold").agg(gram(columns, F.lit(True)).alias("_g"))
    parts = parts.withColumn("fold", F.explode(F.sequence(F.col("first_fold"), F.lit(n_splits))))
    sums = parts.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("_g"))).alias("_g"))
    solved = sums.select("fold", _ridge_solver(m, alpha)("_g").alias("_c"))
    coefficients = F.slice("_c", 1, m)
    shift = F.aggregate(F.zip_with(coefficients, F.lit(centre.c), lambda a, b: a * b), dbl(0.0), lambda s, v: s + v)
    intercept = F.col("_c")[m] + dbl(centre.y) - shift
    return solved.select("fold", coefficients.alias("coefficients"), intercept.alias("intercept"))


def ridge_fold_predictions(rows: DataFrame, spec: SeriesSpec, n_splits: int = 5, alpha: float = 1.0, name: str = "ridge") -> DataFrame:
    fits = ridge_by_fold(rows, n_splits, alpha)
    test = rows.where(F.col("test_fold").isNotNull()).join(fits, rows["test_fold"] == fits["fold"])
    products = F.zip_with(vector_to_array("features"), F.col("coefficients"), lambda a, b: a * b)
    yhat = F.aggregate(products, dbl(0.0), lambda s, v: s + v) + F.col("intercept")
    return test.select(*spec.ids, "fold", F.lit(name).alias("model"), F.col("label").alias("y"), yhat.alias("yhat"))


def fold_predictions(
    rows: DataFrame, spec: SeriesSpec, models: Sequence[str], fits: dict, n_splits: int = 5, test_size: int = 12
) -> DataFrame:
    """keys, time, fold, model, y, yhat of every test row by the named feature models; ``rows`` should be a written table."""
    marked = with_folds(rows, n_splits, test_size)
    parts = [ridge_fold_predictions(marked, spec, n_splits)] if "ridge" in models else []

    def fitted(m: str, k: int) -> DataFrame | None:
        train = marked.where(F.col("first_fold") <= k)
        if train.first() is None:
            return None
        ahead = ml.predict(fits[m](train), marked.where(F.col("test_fold") == k), spec, m)
        return ahead.select(*spec.ids, F.lit(k).alias("fold"), "model", "y", "yhat")

    # the largest folds first, as they take longest
    work = [partial(fitted, m, k) for k in range(n_splits, 0, -1) for m in models if m != "ridge"]
    parts += [p for p in ml.side_by_side(rows.sparkSession, work) if p is not None]
    if not parts:
        return marked.limit(0).select(*spec.ids, F.lit(1).alias("fold"), F.lit("").alias("model"), F.col("label").alias("y"), F.col("label").alias("yhat"))
    return reduce(DataFrame.unionByName, parts)
