"""Filters, calendar completion, dedup, imputation and the joins the analyses need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import div, month_label, require
from tidemill.spec import SeriesSpec

IMPUTE_METHODS = ("forward", "backward", "interpolate", "spline", "mean", "median")


# -- filters -----------------------------------------------------------------


def date_range_filter(df: DataFrame, spec: SeriesSpec, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between start and end, both included and both optional."""
    if start is not None:
        df = df.where(spec.t >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(spec.t <= F.lit(end).cast("date"))
    return df


def last_n_periods(df: DataFrame, spec: SeriesSpec, n: int | None) -> DataFrame:
    """Newest n rows of every series; None keeps all."""
    if n is None:
        return df
    return (
        df.withColumn("_age", F.row_number().over(spec.reversed())).where(F.col("_age") <= n).drop("_age")
    )


def split_last_n(df: DataFrame, spec: SeriesSpec, n: int = 12) -> DataFrame:
    """Marks the newest n rows of each series as 'test', the rest as 'train'."""
    age = F.row_number().over(spec.reversed())
    return df.withColumn("split", F.when(age <= n, F.lit("test")).otherwise(F.lit("train")))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without nulls in the given columns (default: all)."""
    return df.dropna(subset=columns)


def null_out_nonpositive(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Values at or below zero become null; ``was_nonpositive`` tells which."""
    bad = F.coalesce(spec.y <= 0, F.lit(False))
    return df.withColumn("was_nonpositive", bad).withColumn(spec.value, F.when(spec.y > 0, spec.y))


def cleaning_report(raw: DataFrame, filled: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per key: raw rows, duplicate periods, non-positive and null values, missing periods.

    The raw side may hold many rows per period, so it is combined per (keys, period) first.
    """
    y = spec.y
    per_period = raw.groupBy(*spec.ids).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(y <= 0).alias("nonpositive"),
        F.count_if(y.isNull()).alias("nulls"),
    )
    before = per_period.groupBy(*spec.keys).agg(
        F.sum("rows").alias("original_rows"),
        F.sum(F.col("rows") - 1).alias("duplicates_removed"),
        F.sum("nonpositive").alias("nonpositive"),
        F.sum("nulls").alias("nulls"),
        F.count(F.lit(1)).alias("_observed"),
    )
    after = filled.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("rows_after"), F.count_if(y.isNull()).alias("missing_after")
    )
    joined = before.join(after, list(spec.keys))
    return joined.withColumn("missing_periods", F.col("rows_after") - F.col("_observed")).drop("_observed")


# -- calendar ----------------------------------------------------------------


MAX_GAP = 1_000_000


def calendar_fill(df: DataFrame, spec: SeriesSpec, fill: str = "null", max_gap: int = MAX_GAP) -> DataFrame:
    """Complete calendar grid between the first and last row of each series.

    Each row emits itself and the steps up to its successor, so the grid needs
    one window (shared with later windows on the same keys) and no join.
    ``fill='zero'`` suits flow measures, where no row means nothing happened.
    A gap of more than ``max_gap`` steps is a broken time value and fails the job
    with its key, rather than filling a task with invented rows.
    """
    require(df, *spec.ids, spec.value)
    others = [c for c in df.columns if c not in spec.ids]
    until = F.coalesce(spec.shift(F.lead(spec.time).over(spec.ordered()), -1), spec.t)
    gap = spec.steps_between(spec.t, F.col("_until"))
    where = F.concat_ws(" ", *[F.col(c).cast("string") for c in spec.ids])
    broken = F.raise_error(F.concat(F.lit(f"calendar gap of more than {max_gap} steps after "), where))
    grid = (
        df.withColumn("_until", until)
        .withColumn("_step", F.explode(F.when(gap <= max_gap, spec.calendar(spec.t, F.col("_until"))).otherwise(broken)))
        .withColumn("is_gap", F.col("_step") != spec.t)
    )
    kept = []
    for name in others:
        missing = F.lit(0.0) if fill == "zero" and name == spec.value else F.lit(None)
        kept.append(F.when(~F.col("is_gap"), F.col(name)).otherwise(missing).alias(name))
    return grid.select(*spec.keys, F.col("_step").alias(spec.time), *kept, "is_gap")


def missing_periods(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Calendar steps inside a series that have no row."""
    nxt = F.lead(spec.time).over(spec.ordered())
    gaps = df.select(*spec.ids).withColumn("_next", nxt).where(F.col("_next") > spec.shift(spec.t, 1))
    steps = F.explode(spec.calendar(spec.shift(spec.t, 1), spec.shift(F.col("_next"), -1)))
    return gaps.select(*spec.keys, steps.alias(spec.time))


def future_calendar(df: DataFrame, spec: SeriesSpec, horizon: int = 12) -> DataFrame:
    """The next ``horizon`` steps after the last row of each series, with step numbers from 1."""
    last = df.groupBy(*spec.keys).agg(F.max(spec.time).alias("_last"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *spec.keys, "step", spec.shift(F.col("_last"), F.col("step")).alias(spec.time)
    )


# -- joins and set operations ------------------------------------------------


def flag_join(df: DataFrame, marked: DataFrame, spec: SeriesSpec, flag: str = "is_anomaly") -> DataFrame:
    """Adds a flag that tells whether (keys, time) occurs in ``marked``."""
    hits = marked.select(*spec.ids).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(hits, spec.ids, "left")
    return joined.withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def exclude_anomalies(df: DataFrame, anomalies: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.join(anomalies.select(*spec.ids), spec.ids, "left_anti")


def only_anomalies(df: DataFrame, anomalies: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.join(anomalies.select(*spec.ids), spec.ids, "left_semi")


def union_anomalies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct union; columns one side lacks are null."""
    return first.unionByName(second, allowMissingColumns=True).dropDuplicates()


def align_models(forecasts: DataFrame, spec: SeriesSpec, models: list[str], value: str = "yhat") -> DataFrame:
    """Long forecasts to one column per model, side by side per (keys, time)."""
    picks = [F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models]
    return forecasts.groupBy(*spec.ids).agg(*picks)


def backtest_join(forecasts: DataFrame, actuals: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Forecast rows with the value that came true, where known, and the error."""
    actual = actuals.select(*spec.ids, spec.y.alias("actual"))
    joined = forecasts.join(actual, spec.ids, "left")
    return joined.withColumn("error", F.col("actual") - F.col("yhat"))


def history_plus_forecast(history: DataFrame, forecasts: DataFrame, spec: SeriesSpec) -> DataFrame:
    """History rows followed by forecast rows, told apart by ``kind``."""
    past = history.select(*spec.ids, spec.y.alias("y"), F.lit("history").alias("kind"), F.lit(None).cast("string").alias("model"))
    ahead = forecasts.select(*spec.ids, F.col("yhat").alias("y"), F.lit("forecast").alias("kind"), "model")
    return past.unionByName(ahead)


# -- dedup -------------------------------------------------------------------


def dedupe_keep_last(df: DataFrame, spec: SeriesSpec, seq: str) -> DataFrame:
    """One row per (keys, time): the one with the highest ``seq``.

    Rows without a ``seq`` come last; ties go to the row whose other columns, in their order, are the
    largest. An aggregate, not a window, so any number of copies of one period are
    combined map-side instead of meeting in one task.
    """
    others = [c for c in df.columns if c not in spec.ids]
    best = F.max_by(F.struct(*others), F.struct(seq, *others)).alias("_best")
    return df.groupBy(*spec.ids).agg(best).select(*spec.ids, "_best.*")


# -- imputation --------------------------------------------------------------


def _forward(spec: SeriesSpec):
    frame = spec.ordered().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(spec.value, ignorenulls=True).over(frame)


def _backward(spec: SeriesSpec):
    frame = spec.reversed().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(spec.value, ignorenulls=True).over(frame)


def _with_result(df: DataFrame, spec: SeriesSpec, value) -> DataFrame:
    """Replaces the value column and records which rows were filled."""
    out = df.withColumn("_filled", value)
    return out.withColumn("imputed", spec.y.isNull() & F.col("_filled").isNotNull()).withColumn(
        spec.value, F.col("_filled")
    ).drop("_filled")


def impute_forward(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _with_result(df, spec, _forward(spec))


def impute_backward(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _with_result(df, spec, _backward(spec))


def impute_mean(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _with_result(df, spec, F.coalesce(spec.y, F.avg(spec.value).over(spec.whole())))


def impute_median(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _with_result(df, spec, F.coalesce(spec.y, F.percentile(spec.y, F.lit(0.5)).over(spec.whole())))


def impute_linear(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Linear interpolation by row position; leading nulls stay, trailing ones take the last value."""
    known = F.when(spec.y.isNotNull(), F.struct(F.col("_pos"), spec.y.alias("v")))
    before = F.last(known, ignorenulls=True).over(spec.ordered().rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(spec.reversed().rowsBetween(Window.unboundedPreceding, 0))
    placed = df.withColumn("_pos", F.row_number().over(spec.ordered()))
    placed = placed.withColumn("_a", before).withColumn("_b", after)
    a, b = F.col("_a"), F.col("_b")
    slope = div(b["v"] - a["v"], (b["_pos"] - a["_pos"]).cast("double"))
    between = a["v"] + slope * (F.col("_pos") - a["_pos"]).cast("double")
    value = F.when(spec.y.isNotNull(), spec.y).when(b.isNull(), a["v"]).otherwise(between)
    return _with_result(placed, spec, value).drop("_pos", "_a", "_b")


def _natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y); ends continue with the boundary polynomials."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    rhs = np.zeros(n)
    rhs[1:-1] = 6.0 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1])
    # tridiagonal system for the second derivatives, zero at both ends
    low, mid, up = np.r_[h[:-1], 0.0], np.r_[1.0, 2.0 * (h[:-1] + h[1:]), 1.0], np.r_[0.0, h[1:]]
    for i in range(1, n):
        w = low[i - 1] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m = np.zeros(n)
    m[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        m[i] = (rhs[i] - up[i] * m[i + 1]) / mid[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d, e = at - x[k], x[k + 1] - at
    return (
        m[k] * e**3 / (6 * h[k])
        + m[k + 1] * d**3 / (6 * h[k])
        + (y[k] / h[k] - m[k] * h[k] / 6) * e
        + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * d
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spline_filled(series: pd.Series) -> pd.Series:
    """Every array of a batch with its nulls filled; arrays without a value stay as they are."""

    def fill(values) -> list[float | None]:
        y = np.array([np.nan if v is None else v for v in values], dtype=float)
        known = np.isfinite(y)
        if known.any() and not known.all():
            pos = np.arange(len(y), dtype=float)
            y[~known] = _natural_spline(pos[known], y[known], pos[~known])
        return [None if np.isnan(v) else v for v in y.tolist()]

    return series.map(fill)


def impute_spline(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Natural cubic spline by row position, through the known values (it interpolates, it does not smooth).

    A series is one array, bounded by its calendar; many series are filled per Arrow batch.
    """
    others = [c for c in df.columns if c not in spec.ids]
    rows = F.sort_array(F.collect_list(F.struct(spec.time, *others)))
    series = df.groupBy(*spec.keys).agg(rows.alias("_rows"))
    values = F.transform("_rows", lambda r: r[spec.value].cast("double"))
    series = series.withColumn("_fill", _spline_filled(values))
    flat = series.select(*spec.keys, "_fill", F.posexplode("_rows").alias("_at", "_r"))
    filled = F.get("_fill", F.col("_at"))
    columns = {c: F.col("_r")[c] for c in (spec.time, *others)} | {spec.value: filled}
    return flat.select(
        *(F.col(c) if c in spec.keys else columns[c].alias(c) for c in df.columns), F.col("_r")[spec.value].isNull().alias("imputed")
    )


def impute(df: DataFrame, spec: SeriesSpec, method: str = "interpolate") -> DataFrame:
    fills = {
        "forward": impute_forward,
        "backward": impute_backward,
        "interpolate": impute_linear,
        "spline": impute_spline,
        "mean": impute_mean,
        "median": impute_median,
    }
    if method not in fills:
        raise ValueError(f"unknown imputation method {method!r}, expected one of {IMPUTE_METHODS}")
    return fills[method](df, spec)


def impute_report(filled: DataFrame, spec: SeriesSpec, method: str = "interpolate") -> DataFrame:
    """Per key: method, nulls before and after, how many were filled, first five filled months."""
    done = F.count_if(F.col("imputed"))
    left = F.count_if(spec.y.isNull())
    first_five = F.slice(
        F.array_sort(F.collect_list(F.when(F.col("imputed"), month_label(spec.t)))), 1, 5
    )
    return filled.groupBy(*spec.keys).agg(
        F.when(done + left == 0, F.lit("none")).otherwise(F.lit(method)).alias("method"),
        (done + left).alias("missing_before"),
        left.alias("missing_after"),
        done.alias("values_imputed"),
        F.array_join(first_five, ",").alias("imputed_dates"),
    )


def clean(df: DataFrame, spec: SeriesSpec, seq: str | None = None, method: str = "interpolate") -> DataFrame:
    """Dedupe, null out bad values, complete the calendar and impute, as one lazy plan."""
    if seq:
        df = dedupe_keep_last(df, spec, seq)
    df = null_out_nonpositive(df, spec).drop("was_nonpositive")
    return impute(calendar_fill(df, spec), spec, method)


# -- validation --------------------------------------------------------------


def validate_schema(df: DataFrame, spec: SeriesSpec, required: list[str]) -> DataFrame:
    """One row: missing columns (checked on the schema alone), row count and time range."""
    missing = [c for c in required if c not in df.columns]
    has_time = spec.time in df.columns
    return df.agg(
        F.lit(not missing).alias("valid"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.count(F.lit(1)).alias("row_count"),
        (month_label(F.min(spec.time)) if has_time else F.lit(None).cast("string")).alias("start"),
        (month_label(F.max(spec.time)) if has_time else F.lit(None).cast("string")).alias("end"),
    )


def order_violations(df: DataFrame, spec: SeriesSpec, seq: str, block: int = 1_000_000) -> DataFrame:
    """Per key: rows that are older than the row before them in ingest order.

    Rows are compared inside blocks of the sequence number and blocks only with
    their neighbours, so a key of any size is spread over many tasks.
    """
    s = F.col(seq)
    blocked = df.select(*spec.keys, spec.time, s.alias("_s"), F.floor(s / F.lit(block)).alias("_block"))
    inside = Window.partitionBy(*spec.keys, "_block").orderBy("_s")
    steps = blocked.withColumn("_bad", F.coalesce(spec.t < F.lag(spec.time).over(inside), F.lit(False)))
    edges = steps.groupBy(*spec.keys, "_block").agg(
        F.count_if(F.col("_bad")).alias("_inside"),
        F.min_by(spec.time, "_s").alias("_first"),
        F.max_by(spec.time, "_s").alias("_last"),
    )
    seams = Window.partitionBy(*spec.keys).orderBy("_block")
    seam = F.coalesce(F.col("_first") < F.lag("_last").over(seams), F.lit(False)).cast("bigint")
    return edges.withColumn("_seam", seam).groupBy(*spec.keys).agg(
        F.sum(F.col("_inside") + F.col("_seam")).alias("order_violations")
    )


def data_quality(df: DataFrame, spec: SeriesSpec, seq: str | None = None) -> DataFrame:
    """Per key: nulls, non-positive and repeated values, order, basic stats, score 100 - 10 per issue.

    Equal values are combined before the per-key aggregate, which keeps hot keys cheap.
    """
    by_value = df.groupBy(*spec.keys, spec.value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(spec.time).alias("_start"), F.max(spec.time).alias("_end")
    )
    y, n = spec.y, F.col("_n")
    report = by_value.groupBy(*spec.keys).agg(
        F.sum("_n").alias("total_records"),
        F.coalesce(F.sum(F.when(y.isNull(), n)), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.when(y <= 0, n)), F.lit(0)).alias("nonpositive_values"),
        F.sum(n - 1).alias("duplicate_values"),
        div(F.sum(y * n), F.sum(F.when(y.isNotNull(), n)).cast("double")).alias("mean"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        month_label(F.min("_start")).alias("start"),
        month_label(F.max("_end")).alias("end"),
    )
    issues = sum(
        (F.when(F.col(c) > 0, 1).otherwise(0) for c in ("missing_values", "nonpositive_values", "duplicate_values")),
        F.lit(0),
    )
    report = report.withColumn("quality_score", (F.lit(100) - issues * 10).cast("bigint"))
    if seq:
        report = report.join(order_violations(df, spec, seq), list(spec.keys))
        report = report.withColumn("is_ordered", F.col("order_violations") == 0)
    return report
