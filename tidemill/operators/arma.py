"""ARIMA by two-stage least squares on one ordered array per series.

A series is collected once (it is bounded by its calendar); everything after that exchange works on its array: differences, the
first-stage autoregression whose residuals stand in for the shocks, the second-stage regression, and the search over orders.
Cross-products are added up by chunks, so a long series needs no table of all its lags.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.linalg import VECTOR, solve_batch
from tidemill.spec import SeriesSpec

CHUNK = 1 << 16


def once(function):
    """Keeps the optimizer from copying a costly function into filters it derives and evaluating it there again."""
    return function.asNondeterministic()


def value_arrays(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per key: ``values`` in time order, missing ones null, and ``last``, the newest time.

    The partitions are asked for by number and by a hash of the keys: what follows costs far more than the bytes of the
    arrays let adaptive execution expect, and it would otherwise gather thousands of series in one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*spec.keys, F.xxhash64(*spec.keys).alias("_h"), F.struct(spec.t.alias("t"), spec.y.cast("double").alias("y")).alias("_row"))
    out = rows.repartition(partitions, "_h").groupBy("_h", *spec.keys).agg(F.array_sort(F.collect_list("_row")).alias("_all"))
    return out.select(*spec.keys, F.transform("_all", lambda x: x["y"]).alias("values"), F.element_at("_all", -1)["t"].alias("last"))


def numbers(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float) if values is not None else np.empty(0)


def weighted_differences(y: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    """sum of weight[j] * y[t - j] for every t that has all of them."""
    reach = max(weights)
    if len(y) <= reach:
        return np.empty(0)
    return sum(c * y[reach - j : len(y) - j] for j, c in weights.items())


def cross_products(columns: Sequence[tuple[np.ndarray, int]], start: int, constant: bool) -> tuple[np.ndarray, int]:
    """Gram matrix of lagged arrays, a constant after the regressors if asked for, the last column the target; and its rows.

    ``columns`` has (array, lag); rows from ``start`` in which nothing is missing take part.
    """
    n, k = len(columns[0][0]), len(columns) + constant
    gram, used = np.zeros((k, k)), 0
    for at in range(start, n, CHUNK):
        to = min(at + CHUNK, n)
        x = np.ones((to - at, k))
        for c, (a, lag) in enumerate(columns):
            x[:, c if c + 1 < len(columns) else k - 1] = a[at - lag : to - lag]
        whole = np.isfinite(x).all(axis=1)
        if not whole.all():
            x = x[whole]
        gram += x.T @ x
        used += len(x)
    return gram, used


def solved(gram: np.ndarray, ridge: float) -> np.ndarray:
    return solve_batch(gram[None, :-1, :-1].copy(), gram[None, :-1, -1], ridge)[0]


def longest_order(n: int) -> int:
    """First-stage lags a series of ``n`` values may have: 10 log10(n), and twice as many rows as lags."""
    return max(0, min(int(10 * np.log10(n)) if n > 1 else 0, (n - 1) // 3))


def first_stage_order(w: np.ndarray, least: int, constant: bool) -> int:
    """Lags of the long autoregression: the lowest AIC along the Levinson recursion from ``least`` to ``longest_order``."""
    known = np.isfinite(w)
    n = int(known.sum())
    most = longest_order(n)
    least = min(least, most)
    x = np.where(known, w - (w[known].mean() if constant and n else 0.0), 0.0)
    r = np.array([x[k:] @ x[: len(x) - k] for k in range(most + 1)]) / max(n, 1)
    if most == 0 or not r[0] > 0:
        return least
    best, order, spread = np.inf, least, float(r[0])
    phi = np.zeros(most + 1)
    for m in range(1, most + 1):
        last = (r[m] - phi[1:m] @ r[m - 1 : 0 : -1]) / spread
        phi[1:m], phi[m] = phi[1:m] - last * phi[m - 1 : 0 : -1], last
        spread *= 1.0 - last * last
        if not spread > 0:
            break
        aic = n * np.log(spread) + 2 * m
        if m >= least and aic < best:
            best, order = aic, m
    return order


def shocks(w: np.ndarray, order: int, constant: bool) -> np.ndarray:
    """Residuals of the autoregression of that order; missing before it and where a value is."""
    out = np.full(len(w), np.nan)
    if len(w) <= order:
        return out
    gram, used = cross_products([*((w, k) for k in range(1, order + 1)), (w, 0)], order, constant)
    if used <= order:
        return out
    beta = solved(gram, 1e-10)
    out[order:] = np.convolve(w, np.concatenate([[1.0], -beta[:order]]), "valid") - (beta[-1] if constant else 0.0)
    return out


def newest_first(a: np.ndarray, count: int, missing: float | None) -> list[float | None]:
    tail = a[::-1][:count].tolist()
    tail = [missing if v != v else v for v in tail]
    return tail + [missing] * (count - len(tail))


FIT = T.StructType(
    [
        T.StructField("coef", VECTOR), T.StructField("nobs", T.LongType()), T.StructField("order", T.LongType()),
        T.StructField("w_tail", VECTOR), T.StructField("e_tail", VECTOR), T.StructField("y_tail", VECTOR), T.StructField("recent", VECTOR),
    ]
)


def two_stage(shape, damped) -> F.pandas_udf:
    """Column function: values -> coefficients (null where they cannot be fitted), rows used, first-stage order, newest-first tails."""
    weights, constant = shape.difference_weights(), shape.constant
    k = len(shape.ar) + len(shape.ma) + constant

    def fit(values) -> tuple:
        y = numbers(values)
        w = weighted_differences(y, weights)
        order = first_stage_order(w, max([*shape.ar, *shape.ma]), constant) if shape.ma else 0
        e = shocks(w, order, constant) if shape.ma else w
        start = max(order + max(shape.ma, default=0), max(shape.ar, default=0))
        columns = [*((w, lag) for lag in shape.ar), *((e, lag) for lag in shape.ma), (w, 0)]
        gram, nobs = cross_products(columns, start, constant) if len(w) > start else (None, 0)
        beta = damped(solved(gram, 1e-8)[None])[0] if nobs >= 2 * k else np.full(k, np.nan)
        coef = beta.tolist() if np.isfinite(beta).all() else None
        tails = (
            newest_first(w, max(shape.ar, default=1), None), newest_first(e, max(shape.ma, default=1), 0.0),
            newest_first(y, max(sum(shape.diffs), 1), None), [v for v in y[-3:].tolist() if v == v],
        )
        return coef, nobs, order, *tails

    @F.pandas_udf(FIT)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit(v) for v in values], columns=FIT.names)

    return once(run)


BEST = T.StructType(
    [
        T.StructField("p", T.LongType()), T.StructField("d", T.LongType()), T.StructField("q", T.LongType()),
        T.StructField("aic", T.DoubleType()), T.StructField("nobs", T.LongType()),
    ]
)


def best_order(max_p: int, max_d: int, max_q: int, weights_of) -> F.pandas_udf:
    """Column function: values -> the order with the lowest AIC; null where no order can be fitted.

    All orders of one d are sub-models of one regression: one gram matrix per series and d, then one batched solve per (p, q).
    """
    k = max_p + max_q + 1

    @F.pandas_udf(BEST)
    def run(values: pd.Series) -> pd.DataFrame:
        arrays = [numbers(v) for v in values]
        size = len(arrays)
        best, found = np.full(size, np.inf), np.zeros((size, 4), "int64")
        for d in range(max_d + 1):
            grams, n = np.full((size, k + 1, k + 1), np.nan), np.zeros(size)
            for i, y in enumerate(arrays):
                w = weighted_differences(y, weights_of(d))
                order = first_stage_order(w, max(max_p, max_q), d == 0)
                if len(w) > order + max_q:
                    e = shocks(w, order, d == 0) if max_q else w
                    columns = [*((w, j) for j in range(1, max_p + 1)), *((e, j) for j in range(1, max_q + 1)), (w, 0)]
                    grams[i], n[i] = cross_products(columns, max(order + max_q, max_p), True)
            for p in range(1, max_p + 1):
                for q in range(max_q + 1):
                    use = [*range(p), *range(max_p, max_p + q), *([k - 1] if d == 0 else [])]
                    xx, xy = grams[:, use][:, :, use].copy(), grams[:, use, k]
                    sse = grams[:, k, k] - (solve_batch(xx, xy) * xy).sum(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        aic = n * (np.log(2 * np.pi * sse / n) + 1.0) + 2.0 * (len(use) + 1)
                    better = (n > 2 * len(use)) & np.isfinite(aic) & (aic < best)
                    best[better] = aic[better]
                    found[better] = np.column_stack([np.full(size, p), np.full(size, d), np.full(size, q), n])[better]
        ok = np.isfinite(best)
        out = {c: pd.Series(found[:, j]).astype("Int64").where(ok) for j, c in enumerate(("p", "d", "q", "nobs"))}
        return pd.DataFrame({"p": out["p"], "d": out["d"], "q": out["q"], "aic": pd.Series(best).astype("Float64").where(ok), "nobs": out["nobs"]})

    return once(run)
