"""The models that comparisons know by name.

A model is a function of training series, spec and horizon that gives a long forecast (keys, model, step,
time, yhat) of the series it could fit. Series it could not fit have no row: a replacement
is never scored under the model's name; ``failed_fits`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import forecast, ml
from tidemill.operators.prepare import split_last_n
from tidemill.session import cut_lineage
from tidemill.spec import SeriesSpec

Model = Callable[[DataFrame, SeriesSpec, int], DataFrame]



def _fitted(ahead: DataFrame) -> DataFrame:
    """Rows of fitted series only."""
    kept = ahead.where(F.col("status") == "ok").drop("status") if "status" in ahead.columns else ahead
    return kept.where(F.col("yhat").isNotNull())


def _feature_model(name: str, fit: Callable) -> Model:
    """Trained on the rows of all series, fed back step by step."""
    return lambda train, spec, horizon: ml.forecast_recursive(
        fit(cut_lineage(ml.model_rows(train, spec))), train, spec, horizon, name
    )


SERIES_MODELS: dict[str, Model] = {
    "moving_average": lambda train, spec, horizon: forecast.forecast_moving_average(train, spec, 3, horizon),
    "arima": lambda train, spec, horizon: forecast.forecast_arima(train, spec, (2, 1, 2), horizon),
    "sarima": lambda train, spec, horizon: forecast.forecast_sarima(train, spec, horizon),
    "trend_seasonal": lambda train, spec, horizon: forecast.forecast_trend_seasonal(train, spec, horizon),
}
FEATURE_FITS = {"ridge": ml.fit_ridge, "gbt": ml.fit_gbt, "random_forest": ml.fit_random_forest}
FEATURE_MODELS: dict[str, Model] = {name: _feature_model(name, fit) for name, fit in FEATURE_FITS.items()}
MODELS: dict[str, Model] = SERIES_MODELS | FEATURE_MODELS


def forecasts(train: DataFrame, spec: SeriesSpec, horizon: int = 12, models: Iterable[str] = tuple(MODELS)) -> DataFrame:
    """Long forecasts of all named models."""
    work = [partial(lambda m: _fitted(MODELS[m](train, spec, horizon)), m) for m in models]
    return reduce(DataFrame.unionByName, ml.side_by_side(train.sparkSession, work))


def backtest_predictions(df: DataFrame, spec: SeriesSpec, test_size: int = 12, models: Iterable[str] = tuple(MODELS)) -> DataFrame:
    """The newest ``test_size`` rows of every series by every model: keys, model, time, y, yhat.

    Models of single series forecast the stretch from its start; feature models predict each row from the values before it.
    """
    models = tuple(models)
    marked = split_last_n(df, spec, test_size)
    train = marked.where(F.col("split") == "train").drop("split")
    actual = marked.where(F.col("split") == "test").select(*spec.ids, spec.y.alias("y"))
    parts = []
    if own := [m for m in models if m in SERIES_MODELS]:
        parts.append(forecasts(train, spec, test_size, own).drop("step").join(actual, spec.ids))
    if own := [m for m in models if m in FEATURE_MODELS]:
        past, ahead = ml.split_rows(cut_lineage(ml.model_rows(df, spec)), test_size)
        parts += ml.side_by_side(df.sparkSession, [partial(lambda m: ml.predict(FEATURE_FITS[m](past), ahead, spec, m), m) for m in own])
    return reduce(lambda a, b: a.unionByName(b), parts)


def importance_of_fits(train: DataFrame, models: Iterable[str] = tuple(FEATURE_FITS)) -> DataFrame:
    """(model, feature, importance) of feature models fitted on ``train``, a written table of ``ml.model_rows``."""
    names = tuple(models)
    fits = ml.side_by_side(train.sparkSession, [partial(FEATURE_FITS[m], train) for m in names])
    return ml.fitted_importance(dict(zip(names, fits)), train)


def failed_fits(df: DataFrame, ahead: DataFrame, spec: SeriesSpec, models: Iterable[str] = tuple(MODELS)) -> DataFrame:
    """Per model: series in all, and series without a forecast in ``ahead``."""
    keys = df.select(*spec.keys).distinct().withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))
    done = ahead.select(*spec.keys, "model").distinct().withColumn("_done", F.lit(1))
    return keys.join(done, [*spec.keys, "model"], "left").groupBy("model").agg(
        F.count(F.lit(1)).alias("series"), F.count_if(F.col("_done").isNull()).alias("failed")
    )
