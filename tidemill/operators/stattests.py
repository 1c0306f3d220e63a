"""Autocorrelation and stationarity tests for many series at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import dbl, div, ladder
from tidemill.functions.distributions import chi2_tail_even, normal_cdf
from tidemill.operators.linalg import VECTOR, stack
from tidemill.operators.parts import Part, together
from tidemill.spec import SeriesSpec

# -- autocorrelation ---------------------------------------------------------


def _lag_rows(nlags: int):
    def rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
        out = df.withColumn("_d", spec.y - F.avg(spec.value).over(spec.whole()))
        return out.withColumns({f"_l{k}": F.lag("_d", k).over(spec.ordered()) for k in range(1, nlags + 1)})

    return rows


def _lag_sums(nlags: int):
    def aggs(spec: SeriesSpec) -> list[Column]:
        d, n = F.col("_d"), F.count(F.col("_d")).cast("double")
        sums = [F.sum(d * d)] + [F.coalesce(F.sum(d * F.col(f"_l{k}")), dbl(0.0)) for k in range(1, nlags + 1)]
        return [F.count("_d").alias("n"), F.array(*[div(s, n) for s in sums]).alias("acov")]

    return aggs


def autocovariance(df: DataFrame, spec: SeriesSpec, nlags: int) -> DataFrame:
    """Per key: length and the biased autocovariances of lags 0..nlags as an array."""
    return _lag_rows(nlags)(df, spec).groupBy(*spec.keys).agg(*_lag_sums(nlags)(spec))


def _scaled(table: DataFrame, spec: SeriesSpec) -> DataFrame:
    scaled = F.transform("acov", lambda v: v / F.col("acov")[0])
    return table.select(*spec.keys, "n", F.when(F.col("acov")[0] > 0, scaled).alias("acf"))


def acf_arrays(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    """Per key: length and autocorrelations of lags 0..nlags (null for a flat series)."""
    return _scaled(autocovariance(df, spec, nlags), spec)


def band(n: Column) -> Column:
    return div(dbl(1.96), F.sqrt(n.cast("double")))


def by_lag(arrays: DataFrame, spec: SeriesSpec, name: str) -> DataFrame:
    """One row per lag of an array column, with the 95 % band."""
    rows = arrays.select(*spec.keys, "n", F.posexplode(name).alias("lag", name))
    # lags a series is too short for say nothing
    rows = rows.where(F.col("lag") < F.col("n"))
    out = rows.withColumn("band", band(F.col("n")))
    return out.withColumn("is_significant", (F.col("lag") > 0) & (F.abs(F.col(name)) > F.col("band"))).drop("n")


def acf(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    """Autocorrelation per lag with the 95 % band."""
    return by_lag(acf_arrays(df, spec, nlags), spec, "acf")


@F.pandas_udf(VECTOR)
def _durbin_levinson(acfs: pd.Series) -> pd.Series:
    """Partial autocorrelations of a batch of autocorrelation arrays, all keys at once."""
    width = max((len(a) for a in acfs if a is not None), default=1)
    r = stack(acfs, width)
    phi = np.zeros_like(r)
    out = np.full_like(r, np.nan)
    out[:, 0] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, width):
            before = phi[:, 1:k].copy()
            top = r[:, k] - (before * r[:, k - 1 : 0 : -1]).sum(axis=1)
            bottom = 1.0 - (before * r[:, 1:k]).sum(axis=1)
            last = top / bottom
            phi[:, 1:k] = before - last[:, None] * before[:, ::-1]
            phi[:, k] = last
            out[:, k] = last
    return pd.Series([None if a is None else row.tolist() for a, row in zip(acfs, out)], dtype=object)


def with_pacf(arrays: DataFrame) -> DataFrame:
    return arrays.withColumn("pacf", _durbin_levinson("acf"))


def pacf_arrays(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    return with_pacf(acf_arrays(df, spec, nlags))


def pacf(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    """Yule-Walker partial autocorrelation per lag with the 95 % band."""
    return by_lag(pacf_arrays(df, spec, nlags), spec, "pacf")


# Readings of autocorrelations given as results.
READINGS = {
    "annual": "Strong annual seasonality detected (ACF at lag 12)",
    "half": "Moderate semi-annual pattern detected",
    "short": "Short memory - recent values have little influence on future",
    "long": "Long memory - high persistence in the series",
    "ar_strong": "Strong AR(1) component suggested",
    "ar_moderate": "Moderate AR(1) component suggested",
}


def acf_interpretation(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    """Seasonality, memory and AR hints, decay, and the first significant lags."""
    return _acf_reading(acf_arrays(df, spec, nlags), spec, nlags)


def _acf_reading(arrays: DataFrame, spec: SeriesSpec, nlags: int) -> DataFrame:
    rows = with_pacf(arrays)
    a, p = F.col("acf"), F.col("pacf")
    limit = band(F.col("n"))
    significant = F.filter(F.sequence(F.lit(1), F.lit(nlags)), lambda k: F.abs(F.get(a, k)) > limit)
    seasonality = F.when(
        F.abs(a[12]) > 0.5, F.lit(READINGS["annual"])
    ).when(F.abs(a[6]) > 0.5, F.lit(READINGS["half"]))
    memory = F.when(
        F.forall(F.slice(a, 2, 12), lambda v: F.abs(v) < 0.3),
        F.lit(READINGS["short"]),
    ).when(F.abs(a[1]) > 0.8, F.lit(READINGS["long"]))
    order = F.when(p[1] > 0.8, F.lit(READINGS["ar_strong"])).when(
        p[1] > 0.5, F.lit(READINGS["ar_moderate"])
    )
    return rows.select(
        *spec.keys,
        F.when(F.abs(a[12]) > 0.5, F.lit("slow")).otherwise(F.lit("fast")).alias("decay_rate"),
        F.array_join(F.slice(significant, 1, 10), ",").alias("significant_lags"),
        seasonality.alias("seasonality"),
        memory.alias("memory"),
        order.alias("ar_order"),
    )


def autocorrelation_part(nlags: int = 24) -> Part:
    """``acf_interpretation`` as a part of reports."""
    return Part(_lag_sums(nlags), _lag_rows(nlags), lambda table, spec: _acf_reading(_scaled(table, spec), spec, nlags))


def differenced(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First differences, the first row dropped."""
    out = df.withColumn("_w", spec.y - F.lag(spec.value).over(spec.ordered()))
    return out.where(F.col("_w").isNotNull()).withColumn(spec.value, F.col("_w")).drop("_w")


def differenced_acf(df: DataFrame, spec: SeriesSpec, nlags: int = 24) -> DataFrame:
    """ACF and PACF of the first difference per lag."""
    rows = pacf_arrays(differenced(df, spec), spec, nlags)
    both = rows.select(*spec.keys, "n", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "_v"))
    both = both.where(F.col("lag") < F.col("n"))
    return both.select(*spec.keys, "lag", F.col("_v.acf").alias("acf"), F.col("_v.pacf").alias("pacf"), band(F.col("n")).alias("band"))


def ljung_box(df: DataFrame, spec: SeriesSpec, lags: int = 12) -> DataFrame:
    """Ljung-Box Q over an even number of lags; null for series shorter than that."""
    rows = acf_arrays(df, spec, lags)
    n = F.col("n").cast("double")
    terms = [div(F.col("acf")[k] * F.col("acf")[k], n - dbl(float(k))) for k in range(1, lags + 1)]
    q = n * (n + dbl(2.0)) * sum(terms[1:], terms[0])
    out = rows.select(*spec.keys, F.when(F.col("n") > lags, q).alias("lb_stat"))
    out = out.withColumn("lb_pvalue", chi2_tail_even(F.col("lb_stat"), lags))
    return out.withColumn("has_autocorrelation", F.col("lb_pvalue") < 0.05)


# -- KPSS --------------------------------------------------------------------

# Kwiatkowski et al. (1992), level-stationary critical values.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def _dot(values: Column, n: Column, lag: Column) -> Column:
    """Sum of products of an array with itself ``lag`` places later."""
    length = F.greatest(n - lag, F.lit(0)).cast("int")
    product = F.zip_with(
        F.slice(values, lag.cast("int") + 1, length), F.slice(values, F.lit(1), length), lambda a, b: a * b
    )
    return F.aggregate(product, dbl(0.0), lambda acc, v: acc + v)


def _kpss_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    rows = df.withColumn("_e", spec.y - F.avg(spec.value).over(spec.whole()))
    return rows.withColumn("_run", F.sum("_e").over(spec.ordered().rowsBetween(Window.unboundedPreceding, 0)))


def _kpss_aggs(spec: SeriesSpec) -> list[Column]:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(spec.time, "_e"))), lambda s: s["_e"])
    return [
        F.count("_e").alias("n"),
        F.sum(F.col("_run") * F.col("_run")).alias("_eta"),
        F.sum(F.col("_e") * F.col("_e")).alias("_s0"),
        ordered.alias("_r"),
    ]


def kpss_test(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Level-stationarity test with the automatic lag of Hobijn et al. (1998).

    The residuals of one series travel as one array, bounded by its calendar, so
    that any lag the rule picks can be evaluated without a further shuffle.
    """
    return _kpss_reading(_kpss_rows(df, spec).groupBy(*spec.keys).agg(*_kpss_aggs(spec)), spec)


def _kpss_reading(agg: DataFrame, spec: SeriesSpec) -> DataFrame:
    r, count = F.col("_r"), F.col("n")
    n = count.cast("double")
    cover = F.floor(F.pow(n, dbl(2.0 / 9.0)))
    zero = F.struct(div(F.col("_s0"), n).alias("s0"), dbl(0.0).alias("s1"))

    def widen(acc, k):
        prod = div(_dot(r, count, k), n / dbl(2.0))
        return F.struct((acc["s0"] + prod).alias("s0"), (acc["s1"] + k.cast("double") * prod).alias("s1"))

    agg = agg.withColumn("_a", F.aggregate(F.sequence(F.lit(1).cast("bigint"), cover), zero, widen))
    ratio = div(F.col("_a")["s1"], F.col("_a")["s0"])
    gamma = dbl(1.1447) * F.pow(ratio * ratio, dbl(1.0 / 3.0))
    auto = F.least(F.floor(gamma * F.pow(n, dbl(1.0 / 3.0))), count - 1)
    agg = agg.withColumn("lags_used", F.coalesce(auto, F.lit(0)).cast("bigint"))
    lags = F.col("lags_used")
    steps = F.when(lags >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(lags, F.lit(1).cast("bigint")))).otherwise(
        F.array().cast("array<bigint>")
    )
    bartlett = F.aggregate(
        steps, F.col("_s0"),
        lambda acc, k: acc + dbl(2.0) * _dot(r, count, k) * (dbl(1.0) - k.cast("double") / (lags.cast("double") + dbl(1.0))),
    )
    stat = div(div(F.col("_eta"), n * n), div(bartlett, n))
    out = agg.select(*spec.keys, "n", stat.alias("kpss_stat"), "lags_used")
    p = _interpolate(F.col("kpss_stat"), KPSS_POINTS)
    out = out.withColumn("p_value", p).withColumn("is_stationary", F.col("p_value") > 0.05)
    return out.withColumn("conclusion", _stationary_word(F.col("is_stationary")))


def _interpolate(x: Column, points) -> Column:
    """Piecewise linear interpolation, constant outside the points."""
    out = F.when(x <= points[0][0], dbl(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, dbl(y0) + dbl(y1 - y0) * (x - dbl(x0)) / dbl(x1 - x0))
    return out.when(x.isNotNull(), dbl(points[-1][1]))


def _stationary_word(flag: Column) -> Column:
    return F.when(flag, F.lit("Stationary")).otherwise(F.lit("Non-stationary"))


# -- ADF ---------------------------------------------------------------------

# MacKinnon (1994, 2010), one series, constant, no trend.
ADF_TAU_STAR, ADF_TAU_MIN, ADF_TAU_MAX = -1.61, -18.83, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "crit_1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10pct": (-2.56677, -1.5384, -2.809, 0.0),
}


def _solved(xx: np.ndarray, xy: np.ndarray) -> np.ndarray | None:
    try:
        beta = np.linalg.solve(xx, xy)
    except np.linalg.LinAlgError:
        return None
    return beta if np.isfinite(beta).all() else None


def adf_fit(y: np.ndarray) -> tuple[float | None, int | None, int]:
    """t-value of the lagged level, lag order and rows used, for one series in time order; NaN where missing.

    A row is used if its difference and all its regressors are there. Candidates of the lag order
    are sub-models of one matrix of cross-products on the rows that the largest one leaves.
    """
    n = len(y)
    largest = max(min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2), 0)
    if np.isfinite(y).sum() < 2:
        return None, None, 0
    d = np.diff(y)
    # a shift of the level only moves the constant; centring keeps the cross-products well scaled
    table = np.full((n - 1, largest + 3), np.nan)
    table[:, 0], table[:, 1], table[:, -1] = y[:-1] - np.nanmean(y), 1.0, d
    for k in range(1, largest + 1):
        table[k:, 1 + k] = d[:-k]
    common = table[np.isfinite(table).all(axis=1)]
    obs, products = len(common), common.T @ common
    best, lowest = None, math.inf
    for lag in range(largest + 1):
        use = slice(0, 2 + lag)
        beta = _solved(products[use, use], products[use, -1]) if obs > 2 + lag else None
        sse = products[-1, -1] - beta @ products[use, -1] if beta is not None else 0.0
        aic = obs * (math.log(2 * math.pi) + math.log(sse / obs) + 1.0) + 2.0 * (2 + lag) if sse > 0 else math.inf
        if aic < lowest:
            best, lowest = lag, aic
    if best is None:
        return None, None, obs
    rows = table[:, [*range(2 + best), -1]]
    rows = rows[np.isfinite(rows).all(axis=1)]
    products, nobs = rows.T @ rows, len(rows)
    beta = _solved(products[:-1, :-1], products[:-1, -1])
    if beta is None or nobs <= len(beta):
        return None, best, nobs
    sse = products[-1, -1] - beta @ products[:-1, -1]
    first = _solved(products[:-1, :-1], np.eye(len(beta))[0])
    scale = sse / (nobs - len(beta)) * first[0] if first is not None else 0.0
    return (float(beta[0] / math.sqrt(scale)) if scale > 0 else None), best, nobs


ADF_FIT = T.StructType(
    [T.StructField("adf_stat", T.DoubleType()), T.StructField("lags_used", T.LongType()), T.StructField("nobs", T.LongType())]
)


@F.pandas_udf(ADF_FIT)
def _adf(values: pd.Series) -> pd.DataFrame:
    fits = [adf_fit(np.array([np.nan if v is None else v for v in y], dtype=float)) for y in values]
    out = pd.DataFrame(fits, columns=["adf_stat", "lags_used", "nobs"])
    return out.astype({"adf_stat": "Float64", "lags_used": "Int64", "nobs": "int64"})


def adf_test(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; lag order by AIC on a common sample.

    The largest lag is 12 (n/100)^(1/4), at most n/2 - 2. One exchange brings each series, bounded by
    its calendar, into one array; many series are fitted per Arrow batch.
    """
    return _adf_reading(df.groupBy(*spec.keys).agg(*_adf_aggs(spec)), spec)


def _adf_aggs(spec: SeriesSpec) -> list[Column]:
    pairs = F.sort_array(F.collect_list(F.struct(spec.t.alias("t"), spec.y.cast("double").alias("y"))))
    return [F.transform(pairs, lambda p: p["y"]).alias("_values")]


def _adf_reading(series: DataFrame, spec: SeriesSpec) -> DataFrame:
    out = series.select(*spec.keys, _adf("_values").alias("_fit")).select(*spec.keys, "_fit.*")
    tau, size = F.col("adf_stat"), F.col("nobs").cast("double")
    small = normal_cdf(_powers(tau, ADF_SMALL_P))
    large = normal_cdf(_powers(tau, ADF_LARGE_P))
    p = (
        F.when(tau > ADF_TAU_MAX, dbl(1.0)).when(tau < ADF_TAU_MIN, dbl(0.0))
        .when(tau <= ADF_TAU_STAR, small).otherwise(large)
    )
    out = out.withColumn("p_value", F.when(tau.isNotNull(), p))
    for name, c in ADF_CRITICAL.items():
        out = out.withColumn(name, _powers(div(dbl(1.0), size), c))
    out = out.withColumn("is_stationary", F.col("p_value") < 0.05)
    out = out.withColumn("conclusion", _stationary_word(F.col("is_stationary")))
    strength = (
        F.when(F.col("p_value") < 0.01, F.lit("Strong evidence against unit root (p=%.4f). Series is stationary."))
        .when(F.col("p_value") < 0.05, F.lit("Moderate evidence against unit root (p=%.4f). Series is stationary."))
        .otherwise(F.lit("Weak evidence against unit root (p=%.4f). Series may be non-stationary."))
    )
    shown = F.format_number("p_value", 4)
    return out.withColumn("interpretation", F.replace(strength, F.lit("%.4f"), shown))


def _powers(x: Column, c) -> Column:
    """Polynomial with the constant first."""
    out = dbl(c[-1])
    for v in reversed(c[:-1]):
        out = out * x + dbl(v)
    return out


ADF, KPSS = Part(_adf_aggs, finish=_adf_reading), Part(_kpss_aggs, _kpss_rows, _kpss_reading)


def stationarity_verdict(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Both tests together: how many agree, and the differencing advice."""
    tests = together(df, spec, {"adf": ADF, "kpss": KPSS})
    return tests.select(*spec.keys, F.struct(*verdict_columns("adf", "kpss")).alias("_v")).select(*spec.keys, "_v.*")


def verdict_columns(adf: str, kpss: str) -> list[Column]:
    """Columns of the joint verdict from the structures of both tests."""
    flags = [F.col(f"{test}.is_stationary") for test in (adf, kpss)]
    passed = sum((F.coalesce(flag, F.lit(False)).cast("int") for flag in flags), F.lit(0))
    advice = F.when(passed >= 1, F.lit("Series may be stationary. Consider d=0 or d=1 for ARIMA.")).otherwise(
        F.lit("Series is non-stationary. Recommend d=1 or d=2 differencing.")
    )
    results = [
        F.col(f"{test}.{source}").alias(f"{test}_{name}")
        for test in (adf, kpss)
        for name, source in (("stat", f"{test}_stat"), ("p", "p_value"), ("stationary", "is_stationary"))
    ]
    return [
        *results, passed.alias("passed"), (passed >= 1).alias("is_stationary"),
        ladder(passed, ((1.5, "high"), (0.5, "moderate")), "low").alias("confidence"), advice.alias("recommendation"),
    ]
