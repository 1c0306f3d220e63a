"""Pooled feature models on Spark ML: one model learns from the rows of all series.

Features of a row are a function of the values before it, kept newest first in an
array. Training and multi-step forecasting call the same function, so a forecast
step is a plain projection: no window, no shuffle, no second feature definition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, let
from tidemill.operators.describe import at_age, with_index
from tidemill.operators.forecast import long_forecast
from tidemill.operators.shuffles import permuted_place, with_rank
from tidemill.session import cut_lineage
from tidemill.spec import SeriesSpec

LAGS = (1, 3, 6, 12)
WINDOWS = (3, 6, 12)
FESTIVE_MONTHS = (10, 11, 12)
REACH = 13


def past_features(past: Column, t: Column, i: Column) -> dict[str, Column]:
    """Leak-free features from the previous 13 values (newest first), the time and the row index."""
    out: dict[str, Column] = {f"lag_{k}": past[k - 1] for k in LAGS}
    for w in WINDOWS:
        recent = F.slice(past, 1, w)
        mean = F.aggregate(recent, dbl(0.0), lambda a, v: a + v) / dbl(float(w))
        out[f"rolling_mean_{w}"] = mean
        out[f"rolling_std_{w}"] = let(mean, _spread(recent, w))
        out[f"rolling_min_{w}"] = F.array_min(recent)
        out[f"rolling_max_{w}"] = F.array_max(recent)
        out[f"rolling_median_{w}"] = let(F.array_sort(recent), _middle(w))
    month = F.month(t)
    angle = dbl(2.0 * math.pi / 12.0) * month
    out["mom_growth_lag1"] = F.coalesce(div(past[0] - past[1], past[1]), dbl(0.0))
    out["yoy_growth_lag1"] = F.coalesce(div(past[0] - past[12], past[12]), dbl(0.0))
    out["volume_diff_lag1"] = past[0] - past[1]
    for k in (1, 2, 3):
        out[f"fourier_sin_{k}"] = F.sin(angle * dbl(float(k)))
        out[f"fourier_cos_{k}"] = F.cos(angle * dbl(float(k)))
    out["is_festive"] = month.isin(*FESTIVE_MONTHS).cast("double")
    out["days_to_festive"] = F.greatest(F.lit(0), (F.lit(10) - month) * 30).cast("double")
    out["trend"] = i.cast("double")
    return out


def _spread(values: Column, w: int):
    """Sample standard deviation of ``values`` around a given mean."""
    return lambda m: F.sqrt(F.aggregate(values, dbl(0.0), lambda a, v: a + (v - m) * (v - m)) / dbl(float(w - 1)))


def _middle(w: int):
    return lambda s: s[w // 2] if w % 2 else (s[w // 2 - 1] + s[w // 2]) / dbl(2.0)


def feature_names() -> list[str]:
    return list(past_features(F.array(), F.current_date(), F.lit(0)))


def _vector(past: Column, t: Column, i: Column) -> Column:
    def build(p: Column) -> Column:
        return F.array(*[c.cast("double") for c in past_features(p, t, i).values()])

    return array_to_vector(let(past, build))


def model_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Training table: keys, time, features (vector), label, age, n (length of the series); rows without full history left out."""
    rows = with_index(df, spec)
    past = F.reverse(F.collect_list(spec.value).over(spec.ordered().rowsBetween(-REACH, -1)))
    rows = rows.withColumn("_past", past).where((F.size("_past") == REACH) & spec.y.isNotNull())
    return rows.select(
        *spec.ids, _vector(F.col("_past"), spec.t, F.col("i")).alias("features"), spec.y.alias("label"), "age", "n"
    )


def split_rows(rows: DataFrame, test_size: int = 12) -> tuple[DataFrame, DataFrame]:
    """Train and test by time: the newest ``test_size`` rows of each series are the test."""
    return rows.where(F.col("age") > test_size), rows.where(F.col("age") <= test_size)


# -- models ------------------------------------------------------------------


def fit_ridge(train: DataFrame, alpha: float = 1.0):
    """Ridge on standardised features, as one distributed pass of normal equations.

    The penalty is rescaled because the solver standardises the label as well.
    """
    facts = train.agg(F.stddev_pop("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    penalty = alpha * facts.s / facts.n
    return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=True, regParam=penalty).fit(train)


def seeded_rows(train: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt to ``tasks`` partitions by their ids and put in a fixed order there.

    Samples of the tree learners are drawn by partition and place, so a seed means the same model however the input was
    partitioned and whatever its size. ``tasks`` is part of the seed: more for larger tables.
    """
    ids = [c for c in train.columns if c not in ("features", "label")]
    return train.repartition(tasks, *ids).sortWithinPartitions(F.xxhash64(*ids), *ids, "label")


def fit_gbt(train: DataFrame, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42, tasks: int = 4):
    return GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed
    ).fit(seeded_rows(train, tasks))


def fit_random_forest(train: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42, tasks: int = 4):
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(seeded_rows(train, tasks))


def side_by_side(spark, work: Sequence[Callable[[], object]], at_once: int = 8) -> list:
    """Results of independent fits, several at a time: learning trees is a chain of short jobs that leaves most cores idle."""
    if not work:
        return []
    with ThreadPool(min(at_once, len(work))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda f: f()), work)


def predict(model, rows: DataFrame, spec: SeriesSpec, name: str) -> DataFrame:
    """Long predictions: keys, model, time, y, yhat."""
    scored = model.setPredictionCol("yhat").transform(rows)
    return scored.select(*spec.keys, F.lit(name).alias("model"), spec.time, F.col("label").alias("y"), "yhat")


def linear_coefficients(model, spark) -> DataFrame:
    """One row per feature, and the intercept."""
    pairs = [(f, float(c)) for f, c in zip(feature_names(), model.coefficients)]
    return spark.createDataFrame([*pairs, ("intercept", float(model.intercept))], "feature string, coefficient double")


def tree_importance(model, spark, name: str) -> DataFrame:
    """Split importance per feature of a tree model."""
    weights = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(name, f, float(w)) for f, w in zip(feature_names(), weights)], "model string, feature string, importance double"
    )


def fitted_importance(models: dict[str, object], train: DataFrame) -> DataFrame:
    """(model, feature, importance) of fitted models; each model's importances sum to 1.

    Trees: split importance. Linear models: size of the coefficient times the spread of its feature.
    """
    spread = train.agg(vector_to_array(Summarizer.std(F.col("features"))).alias("s")).first().s or []
    rows = []
    for name, model in models.items():
        if hasattr(model, "featureImportances"):
            weights = model.featureImportances.toArray().tolist()
        else:
            weights = [abs(float(c)) * s for c, s in zip(model.coefficients, spread)]
        total = sum(weights) or 1.0
        rows += [(name, f, float(w / total)) for f, w in zip(feature_names(), weights)]
    return train.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def forecast_recursive(
    model, df: DataFrame, spec: SeriesSpec, horizon: int = 12, name: str = "ridge", cut_every: int = 3
) -> DataFrame:
    """Feeds each prediction back as newest value. State per key: recent values newest first, last time, row count."""
    state = with_index(df, spec).where(F.col("age") <= REACH).groupBy(*spec.keys).agg(
        F.array_compact(F.array(*[at_age(spec.y, k) for k in range(1, REACH + 1)])).alias("_values"),
        F.max(spec.time).alias("last"),
        F.max("n").alias("_n"),
    )
    # a series without a whole stretch of recent values keeps its rows, without figures
    unfit = state.where(F.size("_values") != REACH).select(*spec.keys, "last", F.array_repeat(F.lit(None).cast("double"), horizon).alias("path"))
    state = state.where(F.size("_values") == REACH)
    scorer = model.copy().setPredictionCol("_yhat")
    for h in range(1, horizon + 1):
        t = spec.shift(F.col("last"), h)
        state = state.withColumn("features", _vector(F.col("_values"), t, F.col("_n") + (h - 1)))
        state = scorer.transform(state)
        state = state.select(*spec.keys, "last", "_n", F.concat(F.array("_yhat"), F.col("_values")).alias("_values"))
        # a growing chain of projections is planned again at every step
        if h % cut_every == 0 and h < horizon:
            state = cut_lineage(state)
    paths = state.select(*spec.keys, "last", F.reverse(F.slice("_values", 1, horizon)).alias("path")).unionByName(unfit)
    status = F.when(F.col("yhat").isNull(), F.lit("too_short")).otherwise(F.lit("ok"))
    return long_forecast(paths, spec, name).withColumn("status", status)


# -- permutation importance --------------------------------------------------


def permutation_importance(model, rows: DataFrame, spec: SeriesSpec, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Drop of R2 when one feature is shuffled, mean and population std over the repeats.

    Rows get a rank by a hash of their ids; in repeat r, row k takes the features, one after another, of the row that a keyed bijection
    of all ranks names. Every value is used exactly once, the shuffle is over the whole table at every size, and the result depends
    neither on partitions nor on row order. All features and repeats are scored in one job.
    """
    names = feature_names()
    ranked = cut_lineage(with_rank(rows.select(*spec.ids, "features", "label"), spec.ids, "_rank").select("_rank", "features", "label"))
    n = ranked.count()
    key = F.lit(seed).cast("bigint") * F.lit(1_000_003) + F.col("repeat")
    takers = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    takers = takers.withColumn("_giver", permuted_place(F.col("_rank"), key, n))
    givers = ranked.select(F.col("_rank").alias("_giver"), vector_to_array("features").alias("_given"))
    joined = takers.join(givers, "_giver").withColumn("_own", vector_to_array("features"))
    trials = joined.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    mixed = F.transform("_own", lambda v, j: F.when(j == F.col("_f"), F.col("_given")[j]).otherwise(v))
    trials = trials.select("repeat", "_f", "label", array_to_vector(mixed).alias("features"))
    scorer = model.copy().setPredictionCol("_yhat")

    def r2() -> Column:
        e = F.col("label") - F.col("_yhat")
        return dbl(1.0) - div(F.sum(e * e), F.var_pop("label") * F.count("label"))

    base = scorer.transform(ranked).agg(r2().alias("r2")).first().r2
    scored = scorer.transform(trials).groupBy("_f", "repeat").agg(r2().alias("_r2"))
    drop = F.lit(base).cast("double") - F.col("_r2")
    by_feature = scored.groupBy("_f").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("importance_std"))
    label = F.array(*[F.lit(n) for n in names])[F.col("_f")]
    return by_feature.select(label.alias("feature"), "importance", "importance_std")
