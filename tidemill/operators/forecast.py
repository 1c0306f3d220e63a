"""Forecasts of many series at once. A forecast is a long table: keys, model, step, time, yhat."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, stable_round
from tidemill.operators import arma
from tidemill.operators.describe import at_age, with_index
from tidemill.operators.features import rolling_stats
from tidemill.operators.linalg import VECTOR, as_lists, gram, least_squares, stack
from tidemill.spec import SeriesSpec

# What-if presets (growth, festive season, extra boost).
SCENARIO_PRESETS = (
    ("Conservative", 0.03, True, 0.0),
    ("Moderate", 0.08, True, 0.05),
    ("Aggressive", 0.15, True, 0.10),
    ("Festival Special", 0.10, True, 0.15),
)
FESTIVE_MONTHS = (10, 11, 12)


def long_forecast(paths: DataFrame, spec: SeriesSpec, model: str | None = None, path: str = "path", last: str = "last") -> DataFrame:
    """One row per key (and model, where no name is given) with an array of future values -> long forecast."""
    rows = paths.select("*", F.posexplode(path).alias("_at", "yhat"))
    step = (F.col("_at") + 1).cast("int")
    return rows.select(
        *spec.keys, (F.lit(model) if model else F.col("model")).alias("model"), step.alias("step"), spec.shift(F.col(last), step).alias(spec.time), "yhat"
    )


# -- moving average ----------------------------------------------------------


def moving_average_path(recent: Column, horizon: int) -> Column:
    """Repeatedly appends the mean of the last values; ``recent`` runs from old to new."""

    def extend(acc, _):
        tail = acc["tail"]
        mean = div(F.aggregate(tail, dbl(0.0), lambda s, v: s + v), F.size(tail).cast("double"))
        return F.struct(
            F.concat(F.slice(tail, F.lit(2), F.size(tail)), F.array(mean)).alias("tail"),
            F.concat(acc["path"], F.array(mean)).alias("path"),
        )

    start = F.struct(recent.alias("tail"), F.array().cast("array<double>").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, extend)["path"]


def forecast_moving_average(
    df: DataFrame, spec: SeriesSpec, window: int = 3, horizon: int = 12, model: str = "moving_average"
) -> DataFrame:
    """Mean of the last ``window`` values, fed back for each further step."""
    rows = with_index(df, spec).where(F.col("age") <= window)
    newest_last = F.array_compact(F.array(*[at_age(spec.y, k) for k in range(window, 0, -1)]))
    paths = rows.groupBy(*spec.keys).agg(newest_last.alias("_recent"), F.max(spec.time).alias("last"))
    return long_forecast(paths.withColumn("path", moving_average_path(F.col("_recent"), horizon)), spec, model)


def forecast_moving_averages(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (3, 6, 12), horizon: int = 12) -> DataFrame:
    """Several window lengths from one pass, as models ``ma_<window>``."""
    def path(w: int) -> Column:
        recent = F.array_compact(F.array(*[at_age(spec.y, k) for k in range(w, 0, -1)]))
        return F.struct(F.lit(f"ma_{w}").alias("model"), recent.alias("recent"))

    rows = with_index(df, spec).where(F.col("age") <= max(windows))
    paths = rows.groupBy(*spec.keys).agg(F.array(*[path(w) for w in windows]).alias("_paths"), F.max(spec.time).alias("last"))
    paths = paths.select(*spec.keys, "last", F.explode("_paths").alias("_p"))
    paths = paths.select(*spec.keys, F.col("_p.model").alias("model"), "last", moving_average_path(F.col("_p.recent"), horizon).alias("path"))
    return long_forecast(paths, spec)


def one_step_average(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """In-sample one-step predictions of moving averages, long: keys, time, model, y, yhat."""
    means = rolling_stats(spec, windows, median=False)
    rolled = df.withColumns({f"_ma{w}": means[f"rolling_mean_{w}"] for w in windows})
    pairs = F.array(*[F.struct(F.lit(f"ma_{w}").alias("model"), F.col(f"_ma{w}").alias("yhat")) for w in windows])
    rows = rolled.select(*spec.ids, spec.y.alias("y"), F.explode(pairs).alias("_p"))
    return rows.select(*spec.ids, F.col("_p.model").alias("model"), "y", F.col("_p.yhat").alias("yhat")).where(
        F.col("yhat").isNotNull()
    )


# -- ARIMA by two-stage least squares ----------------------------------------


@dataclass(frozen=True)
class ArmaShape:
    """Lags of a (seasonal) ARIMA model: differences, autoregressive and moving-average lags."""

    diffs: tuple[int, ...] = (1,)
    ar: tuple[int, ...] = (1, 2)
    ma: tuple[int, ...] = (1, 2)

    @classmethod
    def arima(cls, p: int, d: int, q: int) -> ArmaShape:
        return cls((1,) * d, tuple(range(1, p + 1)), tuple(range(1, q + 1)))

    @classmethod
    def sarima(cls, period: int = 12) -> ArmaShape:
        """(1,1,1)(1,1,1): the products of the two lag polynomials, coefficients left free."""
        lags = (1, period, period + 1)
        return cls((1, period), lags, lags)

    @property
    def constant(self) -> bool:
        return not self.diffs

    def difference_weights(self) -> dict[int, float]:
        """w_t = sum of weight[j] * y_{t-j}."""
        weights = {0: 1.0}
        for s in self.diffs:
            shifted = {j + s: -c for j, c in weights.items()}
            weights = {j: weights.get(j, 0.0) + shifted.get(j, 0.0) for j in {*weights, *shifted}}
        return {j: c for j, c in sorted(weights.items()) if c}


def _radius(coefficients: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Largest root modulus of each lag polynomial of a batch."""
    order = max(lags)
    companion = np.zeros((len(coefficients), order, order))
    companion[:, 0, [k - 1 for k in lags]] = coefficients
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1.0
    companion[~np.isfinite(companion).all(axis=(1, 2))] = 0.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1)


def _damped(coefficients: np.ndarray, lags: Sequence[int], limit: float = 0.98) -> np.ndarray:
    """Pulls explosive lag polynomials inside the unit circle, others stay as they are."""
    radius = _radius(coefficients, lags)
    factor = np.where(radius > limit, limit / np.maximum(radius, 1e-12), 1.0)
    return coefficients * factor[:, None] ** np.asarray(lags, dtype=float)


def _damper(shape: ArmaShape):
    """Coefficients of a batch with both lag polynomials inside the unit circle."""
    n_ar, n_ma = len(shape.ar), len(shape.ma)

    def damped(beta: np.ndarray) -> np.ndarray:
        if n_ar:
            beta[:, :n_ar] = _damped(beta[:, :n_ar], shape.ar)
        if n_ma:
            beta[:, n_ar : n_ar + n_ma] = -_damped(-beta[:, n_ar : n_ar + n_ma], shape.ma)
        return beta

    return damped


def _arma_path(shape: ArmaShape, horizon: int):
    """Batch recursion: coefficients and newest-first tails of w, e and y -> future values."""
    back = {j: -c for j, c in shape.difference_weights().items() if j}

    @F.pandas_udf(VECTOR)
    def path(coef: pd.Series, w_tail: pd.Series, e_tail: pd.Series, y_tail: pd.Series) -> pd.Series:
        n_ar, n_ma = len(shape.ar), len(shape.ma)
        beta = stack(coef, n_ar + n_ma + shape.constant)
        w = stack(w_tail, max(shape.ar, default=1))
        e = stack(e_tail, max(shape.ma, default=1))
        y = stack(y_tail, max(sum(shape.diffs), 1))
        out = np.empty((len(beta), horizon))
        for h in range(horizon):
            nxt = beta[:, -1].copy() if shape.constant else np.zeros(len(beta))
            for k, lag in enumerate(shape.ar):
                nxt = nxt + beta[:, k] * w[:, lag - 1]
            for k, lag in enumerate(shape.ma):
                nxt = nxt + beta[:, n_ar + k] * e[:, lag - 1]
            level = nxt + sum((c * y[:, j - 1] for j, c in back.items()), np.zeros(len(beta)))
            out[:, h] = level
            w = np.column_stack([nxt, w[:, :-1]])
            e = np.column_stack([np.zeros(len(beta)), e[:, :-1]])
            y = np.column_stack([level, y[:, :-1]])
        return as_lists(out)

    return arma.once(path)


def fit_arma(df: DataFrame, spec: SeriesSpec, shape: ArmaShape) -> DataFrame:
    """Per key: coefficients, tails for forecasting, fit size, order of the first stage and status.

    Hannan-Rissanen: the differenced series is regressed on its own lags and on the lagged residuals of a long
    autoregression, whose order is chosen by AIC and may grow with the length of the series. A missing value leaves the
    rows it touches out of the fit, it never counts as zero.
    """
    fits = arma.value_arrays(df, spec).withColumn("_f", arma.two_stage(shape, _damper(shape))("values"))
    fits = fits.select(*spec.keys, "last", "_f.*").withColumnsRenamed({"recent": "_recent"})
    enough = F.col("nobs") >= 2 * (len(shape.ar) + len(shape.ma) + shape.constant)
    status = F.when(F.col("coef").isNotNull(), F.lit("ok")).when(enough, F.lit("singular")).otherwise(F.lit("too_short"))
    return fits.withColumn("status", status)


def forecast_arma(df: DataFrame, spec: SeriesSpec, shape: ArmaShape, horizon: int, model: str) -> DataFrame:
    """Forecast with status; series too short for the model get the moving average."""
    fits = fit_arma(df, spec, shape)
    path = _arma_path(shape, horizon)("coef", "w_tail", "e_tail", "y_tail")
    fits = fits.withColumn("_path", path)
    fits = fits.withColumn("path", F.coalesce(F.col("_path"), moving_average_path(F.col("_recent"), horizon)))
    recent = (F.col("status") == "ok") & F.col("_path").isNull()
    fits = fits.withColumn("status", F.when(recent, F.lit("no_recent_values")).otherwise(F.col("status")))
    rows = fits.select("*", F.posexplode("path").alias("_at", "yhat"))
    step = (F.col("_at") + 1).cast("int")
    return rows.select(
        *spec.keys, (F.lit(model) if model else F.col("model")).alias("model"), step.alias("step"), spec.shift(F.col("last"), step).alias(spec.time), "yhat", "status"
    )


def forecast_arima(
    df: DataFrame, spec: SeriesSpec, order: tuple[int, int, int] = (2, 1, 2), horizon: int = 12, model: str = "arima"
) -> DataFrame:
    return forecast_arma(df, spec, ArmaShape.arima(*order), horizon, model)


def forecast_sarima(df: DataFrame, spec: SeriesSpec, horizon: int = 12, model: str = "sarima") -> DataFrame:
    """Seasonal model (1,1,1)(1,1,1) with the season of the series."""
    return forecast_arma(df, spec, ArmaShape.sarima(spec.period), horizon, model)


def arima_order_search(
    df: DataFrame, spec: SeriesSpec, max_p: int = 5, max_d: int = 2, max_q: int = 5
) -> DataFrame:
    """Order with the lowest AIC among p 1..max_p, d 0..max_d, q 0..max_q, per key; all from one array per series.

    A series that no order fits keeps its row and says so.
    """
    pick = arma.best_order(max_p, max_d, max_q, lambda d: ArmaShape((1,) * d, (), ()).difference_weights())
    best = arma.value_arrays(df, spec).withColumn("_b", pick("values"))
    status = F.when(F.col("_b.aic").isNull(), F.lit("too_short")).otherwise(F.lit("ok"))
    return best.select(*spec.keys, "_b.*", status.alias("status"))


# -- trend and season --------------------------------------------------------


@dataclass(frozen=True)
class TrendSeason:
    """Piecewise-linear trend and Fourier season; priors are standard deviations in scaled units."""

    changepoints: int = 10
    history: float = 0.8
    changepoint_prior: float = 0.05
    seasonality_prior: float = 10.0
    noise: float = 0.1

    def orders(self, period: int) -> int:
        # beyond half the period a harmonic repeats a lower one on the grid
        return min(10, (period - 1) // 2)

    def terms(self, spec: SeriesSpec, i: Column, n: Column) -> tuple[list[Column], list[Column]]:
        t = i.cast("double") / n.cast("double")
        knots = [self.history * (c + 1) / (self.changepoints + 1) for c in range(self.changepoints)]
        trend = [dbl(1.0), t, *[F.greatest(t - dbl(k), dbl(0.0)) for k in knots]]
        season = []
        for k in range(1, self.orders(spec.period) + 1):
            angle = dbl(2.0 * np.pi * k / spec.period) * i.cast("double")
            season += [F.sin(angle), F.cos(angle)]
        return trend, season

    def penalties(self, spec: SeriesSpec) -> list[float]:
        hinge = (self.noise / self.changepoint_prior) ** 2
        season = (self.noise / self.seasonality_prior) ** 2
        return [1e-6, 1e-6, *[hinge] * self.changepoints, *[season] * (2 * self.orders(spec.period))]


def fit_trend_seasonal(df: DataFrame, spec: SeriesSpec, shape: TrendSeason = TrendSeason()) -> DataFrame:
    """Coefficients per key by penalised least squares on the whole history."""
    rows = with_index(df, spec).withColumn("_scale", F.max(F.abs(spec.y)).over(spec.whole()))
    trend, season = shape.terms(spec, F.col("i"), F.col("n"))
    terms = [*trend, *season]
    target = div(spec.y, F.col("_scale"))
    fits = rows.groupBy(*spec.keys).agg(
        gram([*terms, target], spec.y.isNotNull()).alias("_g"),
        F.max("n").alias("n"), F.max("_scale").alias("scale"), F.max(spec.time).alias("last"),
    )
    solve = least_squares(len(terms), shape.penalties(spec))
    return fits.select(*spec.keys, "n", "scale", "last", solve("_g").alias("coef"))


def _dot(coef: Column, terms: Sequence[Column], offset: int = 0) -> Column:
    parts = [coef[offset + k] * x for k, x in enumerate(terms)]
    return sum(parts[1:], parts[0])


def trend_seasonal_components(
    df: DataFrame, spec: SeriesSpec, horizon: int = 12, shape: TrendSeason = TrendSeason()
) -> DataFrame:
    """Trend, season and their sum for history and future; step is 0 or less in the history.

    A series that cannot be fitted (no value but null or zero) keeps its rows, with nulls.
    """
    fits = fit_trend_seasonal(df, spec, shape)
    index = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1 + horizon))
    rows = fits.withColumn("i", index)
    trend, season = shape.terms(spec, F.col("i"), F.col("n"))
    step = (F.col("i") - F.col("n") + 1).cast("int")
    rows = rows.withColumn("trend", F.col("scale") * _dot(F.col("coef"), trend))
    rows = rows.withColumn("seasonal", F.col("scale") * _dot(F.col("coef"), season, len(trend)))
    return rows.select(
        *spec.keys, step.alias("step"), spec.shift(F.col("last"), step).alias(spec.time), "trend", "seasonal",
        (F.col("trend") + F.col("seasonal")).alias("yhat"),
    )


def forecast_trend_seasonal(
    df: DataFrame, spec: SeriesSpec, horizon: int = 12, model: str = "trend_seasonal"
) -> DataFrame:
    parts = trend_seasonal_components(df, spec, horizon).where(F.col("step") >= 1)
    return parts.select(*spec.keys, F.lit(model).alias("model"), "step", spec.time, "yhat")


# -- scenarios ---------------------------------------------------------------


def scenario_rows(scenarios=SCENARIO_PRESETS) -> Column:
    """Scenarios as an array literal, to be exploded next to each series."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), dbl(g).alias("growth"), F.lit(f).alias("festive"), dbl(c).alias("custom"))
            for name, g, f, c in scenarios
        ]
    )


def scenario_presets(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Every preset next to the last value of every series."""
    last = df.groupBy(*spec.keys).agg(F.max_by(spec.value, spec.time).alias("last_value"), F.max(spec.time).alias("last"))
    return last.select(*spec.keys, "last_value", "last", F.explode(scenario_rows()).alias("_s")).select(
        *spec.keys, "last_value", "last", "_s.*"
    )


def scenario_projection(
    df: DataFrame, spec: SeriesSpec, scenarios=SCENARIO_PRESETS, horizon: int = 12
) -> DataFrame:
    """What-if path: compound growth, festive months times 1.15, extra boost; with total and peak."""
    last = df.groupBy(*spec.keys).agg(F.max_by(spec.value, spec.time).alias("_y"), F.max(spec.time).alias("_last"))
    rows = last.select("*", F.explode(scenario_rows(scenarios)).alias("_s"))

    def value(step: Column) -> Column:
        grown = F.col("_y") * F.pow(dbl(1.0) + F.col("_s.growth"), step.cast("double"))
        month = F.month(spec.shift(F.col("_last"), step))
        season = F.when(F.col("_s.festive") & month.isin(*FESTIVE_MONTHS), dbl(1.15)).otherwise(dbl(1.0))
        return stable_round(grown * season * (dbl(1.0) + F.col("_s.custom")), 2)

    rows = rows.withColumn("_path", F.transform(F.sequence(F.lit(1), F.lit(horizon)), value))
    peak = F.array_max("_path")
    rows = rows.withColumns(
        {
            "total": stable_round(F.aggregate("_path", dbl(0.0), lambda a, v: a + v), 2),
            "peak": peak,
            "peak_month": F.date_format(spec.shift(F.col("_last"), F.array_position("_path", peak).cast("int")), "MMM"),
        }
    )
    rows = rows.select("*", F.posexplode("_path").alias("_at", "yhat"))
    step = (F.col("_at") + 1).cast("int")
    return rows.select(
        *spec.keys, F.col("_s.scenario").alias("scenario"), step.alias("step"),
        spec.shift(F.col("_last"), step).alias(spec.time), "yhat", "total", "peak", "peak_month",
    )
