"""Long and plain exports as CSV or JSON folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import month_label, stable_round
from tidemill.spec import SeriesSpec


def write_text(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}, expected 'csv' or 'json'")


def export_forecast_long(forecasts: DataFrame, spec: SeriesSpec, metrics: DataFrame | None = None) -> DataFrame:
    """Rows date, model, prediction with bounds where present, or with the model's errors."""
    base = [*spec.keys, month_label(spec.t).alias("date"), "model", stable_round(F.col("yhat"), 2).alias("prediction")]
    if metrics is not None:
        joined = forecasts.join(metrics.select(*spec.keys, "model", "rmse", "mae", "mape"), [*spec.keys, "model"])
        return joined.select(*base, "rmse", "mae", "mape")
    bounds = [stable_round(F.col(c), 2).alias(f"confidence_{c}") for c in ("lower", "upper") if c in forecasts.columns]
    return forecasts.select(*base, *bounds)


def export_series(df: DataFrame, spec: SeriesSpec, path: str, fmt: str = "csv") -> None:
    """A series with its values as CSV or JSON, times as yyyy-MM."""
    write_text(df.withColumn(spec.time, month_label(spec.t)), path, fmt)
