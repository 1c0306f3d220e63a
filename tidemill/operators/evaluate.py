"""Error measures, residual diagnostics, walk-forward validation and model ranking.

Predictions are long: keys, model, time, y, yhat. All measures of a table come
from one grouped aggregate by (keys, model)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, stable_round
from tidemill.functions.distributions import normal_cdf, student_two_sided
from tidemill.operators import describe as ds
from tidemill.operators import stattests as st
from tidemill.operators import ml
from tidemill.operators.folds import fold_predictions
from tidemill.operators.model_set import FEATURE_FITS, FEATURE_MODELS, MODELS, SERIES_MODELS, backtest_predictions, forecasts
from tidemill.session import cut_lineage
from tidemill.spec import SeriesSpec


# Fixed value: the reason given where a series is too short for a test.
TOO_FEW = "Insufficient data"


def by_model(spec: SeriesSpec) -> SeriesSpec:
    """The same series told apart by model, with residuals as value."""
    return SeriesSpec((*spec.keys, "model"), spec.time, "residual", spec.freq, spec.period)


def with_residuals(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("residual", F.col("y") - F.col("yhat"))


def regression_metrics(predictions: DataFrame, spec: SeriesSpec, *extra: str) -> DataFrame:
    """rmse, mae, mape over non-zero values (0 if none), r2 and the spread of absolute errors."""
    y, e = F.col("y"), F.abs(F.col("y") - F.col("yhat"))
    sse = F.sum(e * e)
    return predictions.groupBy(*spec.keys, "model", *extra).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mae"),
        F.coalesce(F.avg(F.when(y != 0, e / F.abs(F.nullif(y, dbl(0.0))))) * dbl(100.0), dbl(0.0)).alias("mape"),
        (dbl(1.0) - div(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        F.stddev_pop(e).alias("std_error"),
        F.count(F.lit(1)).alias("n"),
    )


def pct_improvement(base: Column, new: Column) -> Column:
    """How much smaller ``new`` is than ``base`` in percent; 0 for a base of 0."""
    return F.coalesce(div(base - new, base) * dbl(100.0), dbl(0.0))


# -- residual diagnostics ----------------------------------------------------


def residual_stats(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    e = F.col("residual")
    return with_residuals(predictions).groupBy(*spec.keys, "model").agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"),
        F.percentile(e, dbl(0.5)).alias("median"),
    )


def residual_normality(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Shapiro-Wilk, Jarque-Bera, shape and the verdict; nulls and a reason for fewer than 3 residuals."""
    ms = by_model(spec)
    keys = list(ms.keys)
    rows = with_residuals(predictions)
    sw = ds.shapiro_wilk(rows, ms).select(*keys, "w", F.col("p_value").alias("shapiro_p"), "n")
    jb = ds.jarque_bera(rows, ms).select(*keys, "jb", F.col("p_value").alias("jb_p"))
    shape = ds.skew_kurt(rows, ms).select(*keys, "skewness", "kurtosis")
    out = sw.join(jb, keys).join(shape, keys)
    out = out.select(*keys, *(F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("w", "shapiro_p", "jb", "jb_p", "skewness", "kurtosis")))
    s, k = F.abs("skewness"), F.abs("kurtosis")
    passed = F.col("shapiro_p") > 0.05
    verdict = (
        F.when(F.col("w").isNull(), F.lit(TOO_FEW))
        .when(passed & (s < 1) & (k < 3), F.lit("Residuals appear normally distributed"))
        .when(passed, F.lit("Residuals pass statistical test but may not be perfectly normal"))
        .when((s > 2) | (k > 7), F.lit("Residuals show significant non-normality"))
        .otherwise(F.lit("Residuals may deviate from normality but acceptable for forecasting"))
    )
    return out.withColumn("interpretation", verdict)


def ljung_box(predictions: DataFrame, spec: SeriesSpec, lags: int = 12) -> DataFrame:
    out = st.ljung_box(with_residuals(predictions), by_model(spec), lags)
    text = F.when(F.col("lb_pvalue") > 0.05, F.lit("Residuals are independent")).otherwise(
        F.lit("Residuals show autocorrelation - model may be misspecified")
    )
    return out.withColumn("interpretation", F.when(F.col("lb_stat").isNotNull(), text))


def _correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation, null where a side is constant."""
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def heteroscedasticity(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Correlation of squared residuals with time, plain and by average ranks; nulls and a reason below 10 rows."""
    ms = by_model(spec)
    rows = ds.with_index(with_residuals(predictions), ms)
    rows = rows.withColumn("_e2", F.col("residual") * F.col("residual"))
    # ties share the mean of the ranks they span
    order = Window.partitionBy(*ms.keys).orderBy("_e2")
    tie = Window.partitionBy(*ms.keys, "_e2")
    rows = rows.withColumn("_rank", F.rank().over(order) + (F.count(F.lit(1)).over(tie) - 1) / dbl(2.0))
    x = F.col("i").cast("double")
    out = rows.groupBy(*ms.keys).agg(
        _correlation(x, F.col("_e2")).alias("correlation"), _correlation(x, F.col("_rank")).alias("rho"), F.count(F.lit(1)).alias("_n")
    )
    enough = F.col("_n") >= 10
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("correlation", "rho")})
    rho, dof = F.col("rho"), F.col("_n") - 2
    t = rho * F.sqrt(div(dof.cast("double"), (dbl(1.0) - rho) * (dbl(1.0) + rho)))
    out = out.withColumn("rho_p_value", F.when(enough, student_two_sided(t, dof))).withColumn("_few", ~enough).drop("_n")
    big = F.abs("correlation") > 0.3
    return out.withColumns(
        {
            "is_heteroscedastic": big,
            "spearman_heteroscedastic": F.col("rho_p_value") < 0.05,
            "interpretation": F.when(F.col("_few"), F.lit(TOO_FEW))
            .when(F.coalesce(F.abs("correlation") < 0.3, F.lit(True)), F.lit("Constant variance"))
            .otherwise(F.lit("Variance changes over time")),
        }
    ).drop("_few")


def runs_test(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Runs above and below the median; nulls and a reason below 10 rows."""
    ms = by_model(spec)
    rows = with_residuals(predictions)
    rows = rows.withColumn("_mid", F.percentile("residual", dbl(0.5)).over(ms.whole()))
    rows = rows.withColumn("_up", (F.col("residual") > F.col("_mid")).cast("int"))
    rows = rows.withColumn("_turn", F.coalesce((F.col("_up") != F.lag("_up").over(ms.ordered())).cast("int"), F.lit(1)))
    out = rows.groupBy(*ms.keys).agg(
        F.sum("_turn").alias("runs"), F.sum("_up").cast("double").alias("_a"),
        F.sum(F.lit(1) - F.col("_up")).cast("double").alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    n, ab = a + b, dbl(2.0) * a * b
    enough = n >= 10
    out = out.withColumns({"runs": F.when(enough, F.col("runs")), "expected_runs": F.when(enough, ab / n + dbl(1.0))})
    variance = div(ab * (ab - n), n * n * (n - dbl(1.0)))
    out = out.withColumn("_v", variance)
    z = F.when(~enough, F.lit(None)).when(F.col("_v") > 0, (F.col("runs") - F.col("expected_runs")) / F.sqrt("_v")).otherwise(dbl(0.0))
    out = out.withColumn("z_statistic", z)
    p = F.when(~enough, F.lit(None)).when(F.col("_v") > 0, dbl(2.0) * (dbl(1.0) - normal_cdf(F.abs("z_statistic")))).otherwise(dbl(1.0))
    out = out.withColumn("p_value", p).withColumn("is_random", F.col("p_value") > 0.05).drop("_a", "_b", "_v")
    text = (
        F.when(F.col("p_value").isNull(), F.lit(TOO_FEW))
        .when(F.col("is_random"), F.lit("Residuals appear random"))
        .otherwise(F.lit("Residuals show patterns"))
    )
    return out.withColumn("interpretation", text)


def interval_coverage(banded: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Share of values inside [lower, upper] in percent."""
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    return banded.groupBy(*spec.keys, "model").agg((F.avg(inside) * dbl(100.0)).alias("coverage_pct"))


def residual_report(predictions: DataFrame, spec: SeriesSpec) -> DataFrame:
    """All residual diagnostics of a (key, model) in one row; the small tables join on it."""
    keys = [*spec.keys, "model"]
    predictions = cut_lineage(predictions.select(*spec.ids, "model", "y", "yhat"))
    stats = residual_stats(predictions, spec)
    normal = residual_normality(predictions, spec).select(*keys, "shapiro_p", "jb_p", "skewness", "kurtosis")
    lb = ljung_box(predictions, spec).select(*keys, "lb_stat", "lb_pvalue", "has_autocorrelation")
    hetero = heteroscedasticity(predictions, spec).select(*keys, "correlation", "rho", "is_heteroscedastic")
    runs = runs_test(predictions, spec).select(*keys, "runs", F.col("p_value").alias("runs_p"), "is_random")
    out = stats
    for part in (normal, lb, hetero, runs):
        out = out.join(part, keys, "left")
    return out


def forecast_quality_text(predictions: DataFrame, spec: SeriesSpec, z: float = 1.96) -> DataFrame:
    """Reading of fit, accuracy, coverage, normality and independence as one text."""
    keys = [*spec.keys, "model"]
    metrics = regression_metrics(predictions, spec).select(*keys, "r2", "mape")
    rows = with_residuals(predictions)
    # the interval has the same width for all rows, so coverage needs only the residuals
    rows = rows.withColumn("_margin", dbl(z) * F.stddev_pop("residual").over(Window.partitionBy(*keys)))
    coverage = rows.groupBy(*keys).agg(
        (F.avg((F.abs("residual") <= F.col("_margin")).cast("double")) * dbl(100.0)).alias("coverage_pct")
    )
    normal = residual_normality(predictions, spec).select(*keys, "shapiro_p")
    lb = ljung_box(predictions, spec).select(*keys, "has_autocorrelation")
    out = metrics.join(coverage, keys).join(normal, keys, "left").join(lb, keys, "left")
    r2, mape = F.col("r2"), F.col("mape")
    fit = (
        F.when(r2 > 0.9, F.lit("Excellent fit (R² > 0.9)")).when(r2 > 0.8, F.lit("Good fit (R² > 0.8)"))
        .when(r2 > 0.6, F.lit("Moderate fit (R² > 0.6)")).otherwise(F.lit("Poor fit (R² < 0.6)"))
    )
    accuracy = F.when(mape < 5, F.lit("High accuracy (MAPE < 5%)")).when(mape < 10, F.lit("Good accuracy (MAPE < 10%)"))
    shown = F.format_string("Reliable confidence intervals (%.0f%% coverage)", stable_round(F.col("coverage_pct"), 0))
    reliable = F.when(F.col("coverage_pct") > 90, shown)
    gauss = F.when(F.col("shapiro_p") > 0.05, F.lit("Residuals are normally distributed"))
    free = F.when(~F.col("has_autocorrelation"), F.lit("No significant autocorrelation in residuals"))
    return out.select(*keys, "coverage_pct", F.concat_ws(". ", fit, accuracy, reliable, gauss, free).alias("interpretation"))


# -- validation --------------------------------------------------------------


def walk_forward_folds(df: DataFrame, spec: SeriesSpec, n_splits: int = 5, test_size: int = 12) -> DataFrame:
    """Rows of every fold, marked train or test; folds with too little history are left out.

    A row is repeated once per fold it belongs to (at most ``n_splits`` times), so
    all folds of all series are fitted by one job keyed by (keys, fold).
    """
    rows = ds.with_index(df, spec).drop("age")
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_splits)))
    rows = rows.withColumn("fold", fold)
    end = F.col("n") - test_size * (n_splits + 1 - F.col("fold"))
    rows = rows.withColumn("_end", end).where((F.col("_end") >= 2 * test_size) & (F.col("i") < F.col("_end") + test_size))
    part = F.when(F.col("i") < F.col("_end"), F.lit("train")).otherwise(F.lit("test"))
    return rows.withColumn("part", part).drop("_end", "i", "n")


def walk_forward_predictions(
    df: DataFrame, spec: SeriesSpec, n_splits: int = 5, test_size: int = 12, models: tuple[str, ...] = ("moving_average", "arima")
) -> DataFrame:
    """Test rows of every fold by each model (any of ``model_set.MODELS``): keys, time, fold, model, y, yhat.

    Models of single series are fitted on the fold's past and forecast its test stretch, all folds in one job; feature models
    learn from the past of all series and predict each test row from the values before it. ``df`` is read several times.
    """
    series = df.select(*spec.ids, spec.y)
    fs = spec.with_keys(*spec.keys, "fold")
    folds = walk_forward_folds(series, spec, n_splits, test_size)
    train = folds.where(F.col("part") == "train").drop("part")
    test = folds.where(F.col("part") == "test").select(*fs.ids, spec.y.alias("y"))
    parts = []
    if own := [m for m in models if m in SERIES_MODELS]:
        parts.append(forecasts(train, fs, test_size, own).drop("step").join(test, fs.ids))
    if own := [m for m in models if m in FEATURE_MODELS]:
        parts.append(fold_predictions(cut_lineage(ml.model_rows(series, spec)), spec, own, FEATURE_FITS, n_splits, test_size))
    return reduce(DataFrame.unionByName, parts)


def walk_forward_cv(
    df: DataFrame, spec: SeriesSpec, n_splits: int = 5, test_size: int = 12, models: tuple[str, ...] = ("moving_average", "arima")
) -> DataFrame:
    """Mean errors over the folds and the population std of their rmse, per key and model.

    ``n_splits`` counts the folds that the model could fit; it is 0, with null errors, for series too short for any.
    """
    series = cut_lineage(df.select(*spec.ids, spec.y))
    predictions = walk_forward_predictions(series, spec, n_splits, test_size, models)
    folds = regression_metrics(predictions, spec, "fold")
    every = series.select(*spec.keys).distinct().withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))
    means = folds.groupBy(*spec.keys, "model").agg(
        F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.avg("mape").alias("mean_mape"),
        F.stddev_pop("rmse").alias("std_rmse"), F.count(F.lit(1)).alias("n_splits"),
    )
    out = every.join(means, [*spec.keys, "model"], "left")
    return out.withColumn("n_splits", F.coalesce("n_splits", F.lit(0).cast("bigint")))


def evaluate_all_models(df: DataFrame, spec: SeriesSpec, test_size: int = 12, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """All models fitted and tested on the same rows: errors, rank and residual diagnostics per key and model."""
    predictions = cut_lineage(backtest_predictions(df, spec, test_size, models))
    ranked = rank_models(regression_metrics(predictions, spec), spec)
    keys = [*spec.keys, "model"]
    diagnostics = residual_report(predictions, spec).select(*keys, F.col("mean").alias("residual_mean"), "shapiro_p", "runs_p")
    return ranked.join(diagnostics, keys)


# -- ranking -----------------------------------------------------------------


def rank_models(metrics: DataFrame, spec: SeriesSpec, metric: str = "rmse") -> DataFrame:
    """Rank from 1 by the metric (ties by name) and the best flag."""
    order = Window.partitionBy(*spec.keys).orderBy(metric, "model")
    return metrics.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


def comparison_summary(metrics: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Best and worst model by rmse and the improvement of the one over the other."""
    key = F.struct("rmse", "model")
    out = metrics.groupBy(*spec.keys).agg(
        F.min_by("model", key).alias("best_model"), F.min("rmse").alias("best_rmse"),
        F.max_by("model", key).alias("worst_model"), F.max("rmse").alias("worst_rmse"),
    )
    return out.withColumn("improvement_over_worst", pct_improvement(F.col("worst_rmse"), F.col("best_rmse")))


def accuracy_gauge(metrics: DataFrame, spec: SeriesSpec) -> DataFrame:
    """100 minus five times the best rmse, at least 20."""
    score = F.greatest(dbl(20.0), dbl(100.0) - dbl(5.0) * F.min("rmse"))
    return metrics.groupBy(*spec.keys).agg(score.alias("accuracy"))


def compare_models_wide(metrics: DataFrame, spec: SeriesSpec, models: list[str]) -> DataFrame:
    """One row per key with the errors of every model side by side."""
    picks = [
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in models for c in ("rmse", "mae", "mape")
    ]
    return metrics.groupBy(*spec.keys).agg(*picks)
