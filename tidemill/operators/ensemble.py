"""Combining forecasts, intervals around them, and choosing between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div
from tidemill.spec import SeriesSpec

Z95, Z99 = 1.96, 2.576


def inverse_rmse_weights(metrics: DataFrame, spec: SeriesSpec, epsilon: float = 0.0) -> DataFrame:
    """Weights 1 / (rmse + epsilon), adding to one per key; models without an error get none."""
    raw = div(dbl(1.0), F.col("rmse") + dbl(epsilon))
    rows = metrics.select(*spec.keys, "model", raw.alias("_raw")).where(F.col("_raw").isNotNull())
    return rows.select(*spec.keys, "model", (F.col("_raw") / F.sum("_raw").over(spec.whole())).alias("weight"))


def ensemble_inverse_rmse(
    forecasts: DataFrame, metrics: DataFrame, spec: SeriesSpec, epsilon: float = 0.0, model: str = "ensemble"
) -> DataFrame:
    """Weighted mean of the models per step; needs two models.

    Dividing by the weights present keeps the result right where a model is missing.
    """
    weighted = forecasts.join(inverse_rmse_weights(metrics, spec, epsilon), [*spec.keys, "model"])
    total = weighted.groupBy(*spec.ids).agg(
        (F.sum(F.col("yhat") * F.col("weight")) / F.sum("weight")).alias("yhat"), F.count(F.lit(1)).alias("models_used")
    )
    return total.where(F.col("models_used") >= 2).withColumn("model", F.lit(model))


def ensemble_equal(forecasts: DataFrame, spec: SeriesSpec, model: str = "ensemble_equal") -> DataFrame:
    out = forecasts.groupBy(*spec.ids).agg(F.avg("yhat").alias("yhat"), F.count(F.lit(1)).alias("models_used"))
    return out.withColumn("model", F.lit(model))


def ensemble_interval(
    forecasts: DataFrame, spec: SeriesSpec, metrics: DataFrame | None = None, z: float = Z95
) -> DataFrame:
    """Centre +- z population std across models; the centre is weighted when metrics are given."""
    spread = forecasts.groupBy(*spec.ids).agg(F.avg("yhat").alias("_mean"), F.stddev_pop("yhat").alias("spread"))
    if metrics is not None:
        centre = ensemble_inverse_rmse(forecasts, metrics, spec).select(*spec.ids, "yhat")
        spread = spread.join(centre, spec.ids)
    else:
        spread = spread.withColumn("yhat", F.col("_mean"))
    return with_band(spread.drop("_mean"), F.col("yhat"), dbl(z) * F.col("spread"))


def with_band(df: DataFrame, centre: Column, margin: Column) -> DataFrame:
    return df.withColumn("lower", centre - margin).withColumn("upper", centre + margin)


def ensemble_confidence(metrics: DataFrame, spec: SeriesSpec, slope: float = 2.0) -> DataFrame:
    """100 minus a multiple of the mean rmse, kept within 0..100."""
    score = F.greatest(F.least(dbl(100.0) - dbl(slope) * F.avg("rmse"), dbl(100.0)), dbl(0.0))
    return metrics.groupBy(*spec.keys).agg(score.alias("confidence_score"), F.count(F.lit(1)).alias("models"))


# -- intervals ---------------------------------------------------------------


def interval_residual(forecasts: DataFrame, residuals: DataFrame, spec: SeriesSpec, z: float = Z95) -> DataFrame:
    """yhat +- z population std of the model's residuals (columns y, yhat)."""
    keys = [*spec.keys, "model"]
    noise = residuals.groupBy(*keys).agg(F.stddev_pop(F.col("y") - F.col("yhat")).alias("_noise"))
    out = forecasts.join(noise, keys)
    return with_band(out, F.col("yhat"), dbl(z) * F.col("_noise")).drop("_noise")


def interval_percent_error(
    forecasts: DataFrame, metrics: DataFrame, spec: SeriesSpec, error: str = "std_error", z: float = Z95
) -> DataFrame:
    """yhat (1 +- z e / 100): reads an error in units as a percentage, kept for old reports."""
    keys = [*spec.keys, "model"]
    out = forecasts.join(metrics.select(*keys, F.col(error).alias("_e")), keys)
    return with_band(out, F.col("yhat"), F.col("yhat") * dbl(z) * F.col("_e") / dbl(100.0)).drop("_e")


def interval_fixed_pct(forecasts: DataFrame, share: float = 0.1) -> DataFrame:
    """yhat times 1 - share and 1 + share."""
    y = F.col("yhat")
    return forecasts.withColumn("lower", y * dbl(1.0 - share)).withColumn("upper", y * dbl(1.0 + share))


def interval_pred_spread(forecasts: DataFrame, spec: SeriesSpec, z: float = Z95) -> DataFrame:
    """yhat +- z times a tenth of the population std of the path itself."""
    path = Window.partitionBy(*spec.keys, "model")
    out = forecasts.withColumn("_spread", F.stddev_pop("yhat").over(path) * dbl(0.1))
    return with_band(out, F.col("yhat"), dbl(z) * F.col("_spread")).drop("_spread")


# -- choice ------------------------------------------------------------------


def fallback_forecast(
    wanted: DataFrame, other: DataFrame, spec: SeriesSpec, factor: float = 1.05, share: float = 0.1
) -> DataFrame:
    """Forecast of another model scaled by ``factor`` where the wanted model has none, flagged.

    ``factor`` 1.05 with share 0.1 and 1.02 with share 0.08 are the two known uses.
    """
    stand_in = other.select(*spec.ids, (F.col("yhat") * dbl(factor)).alias("_other"))
    own = wanted.select(*spec.ids, F.col("yhat").alias("_own"))
    out = stand_in.join(own, spec.ids, "full")
    out = out.select(
        *spec.ids, F.coalesce("_own", "_other").alias("yhat"), F.col("_own").isNull().alias("fallback")
    )
    y = F.col("yhat")
    return out.withColumn("lower", F.when(F.col("fallback"), y * dbl(1.0 - share))).withColumn(
        "upper", F.when(F.col("fallback"), y * dbl(1.0 + share))
    )


def forecast_model_choice(
    ranked: DataFrame, spec: SeriesSpec, pooled: Sequence[str] = ("ridge", "gbt", "random_forest"), seasonal: str = "sarima"
) -> DataFrame:
    """Best model by rank, but a one-step feature model gives way to the seasonal one for long horizons."""
    best = ranked.where(F.col("rank") == 1).select(*spec.keys, F.col("model").alias("best_model"))
    chosen = F.when(F.col("best_model").isin(*pooled), F.lit(seasonal)).otherwise(F.col("best_model"))
    return best.withColumn("forecast_model", chosen)


def forecast_all_models(forecasts: DataFrame, metrics: DataFrame, spec: SeriesSpec, horizon: int = 12) -> DataFrame:
    """All models up to the horizon with their errors and the best model of the key."""
    best = F.min_by("model", F.struct("rmse", "model")).over(spec.whole())
    named = metrics.withColumn("best_model", best)
    return forecasts.where(F.col("step") <= horizon).join(named, [*spec.keys, "model"])
