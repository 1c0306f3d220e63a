import datetime as dt
import math

import numpy as np
import pytest
from series_rows import make_series, values_of
from pyspark.sql import functions as F
from test_statistics import ar_series

from tidemill.operators import ensemble, evaluate, forecast, ml, prepare
from tidemill.sources import models, versions


def test_moving_average_feeds_back(spark, spec):
    out = values_of(forecast.forecast_moving_average(make_series(spark, {"a": [1, 2, 3, 6]}), spec, 3, 3), "yhat")["a"]
    a = (2 + 3 + 6) / 3
    b = (3 + 6 + a) / 3
    assert np.allclose(out, [a, b, (6 + a + b) / 3])
    short = forecast.forecast_moving_average(make_series(spark, {"a": [4.0]}), spec, 3, 2)
    assert values_of(short, "yhat")["a"] == [4.0, 4.0]


def test_arma_recovers_known_coefficients(spark, spec):
    rng = np.random.default_rng(1)
    n = 1200
    e = rng.normal(size=n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    df = make_series(spark, {"a": np.cumsum(w)}, 1900)
    fit = forecast.fit_arma(df, spec, forecast.ArmaShape.arima(1, 1, 1)).first()
    assert fit.coef == pytest.approx([0.6, 0.4], abs=0.08)


def test_arima_path_follows_the_recursion(spark, spec):
    shape = forecast.ArmaShape.arima(2, 1, 2)
    df = make_series(spark, {"a": np.cumsum(ar_series(0.5, 150))}, 1990)
    fit = forecast.fit_arma(df, spec, shape).first()
    got = values_of(forecast.forecast_arima(df, spec, (2, 1, 2), 5), "yhat")["a"]
    w, e, y = list(fit.w_tail), list(fit.e_tail), fit.y_tail[0]
    want = []
    for _ in range(5):
        nxt = fit.coef[0] * w[0] + fit.coef[1] * w[1] + fit.coef[2] * e[0] + fit.coef[3] * e[1]
        w, e, y = [nxt, w[0]], [0.0, e[0]], y + nxt
        want.append(y)
    assert np.allclose(got, want)


@pytest.mark.parametrize("gap", [False, True])
def test_first_stage_order_grows_with_the_series(spark, spec, gap):
    rng = np.random.default_rng(4)
    n = 2000
    e = rng.normal(size=n)
    w = e.copy()
    for t in range(20, n):
        w[t] = 0.5 * w[t - 1] + e[t] + 0.6 * e[t - 20]
    y = w.tolist()
    if gap:
        y[700] = None
    shape = forecast.ArmaShape((), (1,), (1, 20))
    df = spark.createDataFrame([("a", dt.date(2000, 1, 1) + dt.timedelta(t), v) for t, v in enumerate(y)], "key string, date date, y double")
    fit = forecast.fit_arma(df, spec, shape).first()
    assert 20 < fit.order <= 33  # 10 log10(2000)
    assert fit.coef[:3] == pytest.approx([0.5, 0.0, 0.6], abs=0.12)
    # the same two regressions by a dense solver
    v, m = np.array([np.nan if x is None else x for x in y]), fit.order
    lags = np.column_stack([v[m - k : n - k] for k in range(1, m + 1)] + [np.ones(n - m)])
    use = np.isfinite(lags).all(axis=1) & np.isfinite(v[m:])
    long, *_ = np.linalg.lstsq(lags[use], v[m:][use], rcond=None)
    shock = np.concatenate([np.full(m, np.nan), v[m:] - lags @ long])
    x = np.column_stack([np.roll(v, 1), np.roll(shock, 1), np.roll(shock, 20), np.ones(n)])
    use = np.isfinite(x).all(axis=1) & np.isfinite(v) & (np.arange(n) >= m + 20)
    beta, *_ = np.linalg.lstsq(x[use], v[use], rcond=None)
    assert fit.nobs == use.sum() and np.allclose(fit.coef, beta, atol=1e-6)


def test_long_series_are_fitted_by_chunks(spark, monkeypatch):
    from tidemill.operators import arma

    rng = np.random.default_rng(3)
    w = rng.normal(size=1000)
    w[[5, 400]] = np.nan
    columns = [(w, 1), (w, 7), (w, 0)]
    whole, n = arma.cross_products(columns, 7, True)
    monkeypatch.setattr(arma, "CHUNK", 64)
    parts, m = arma.cross_products(columns, 7, True)
    assert n == m == 993 - 1 - 3 and np.allclose(whole, parts)


def test_one_exchange_after_the_rollup(spark, spec):
    df = make_series(spark, {"a": range(60)})
    for out in (forecast.forecast_arima(df, spec), forecast.forecast_sarima(df, spec), forecast.arima_order_search(df, spec)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_difference_weights():
    assert forecast.ArmaShape.sarima(12).difference_weights() == {0: 1.0, 1: -1.0, 12: -1.0, 13: 1.0}
    assert forecast.ArmaShape.arima(1, 2, 0).difference_weights() == {0: 1.0, 1: -2.0, 2: 1.0}


def test_sarima_continues_trend_and_season(spark, spec):
    y = [100 + 2 * i + 10 * math.sin(2 * math.pi * i / 12) for i in range(96)]
    noise = np.random.default_rng(5).normal(scale=0.1, size=96)
    df = make_series(spark, {"a": np.array(y) + noise, "short": [1.0, 2.0, 3.0]})
    out = forecast.forecast_sarima(df, spec, 12)
    want = [100 + 2 * i + 10 * math.sin(2 * math.pi * i / 12) for i in range(96, 108)]
    assert np.allclose(values_of(out.where("key = 'a'"), "yhat")["a"], want, atol=3.0)
    short = out.where("key = 'short'").collect()
    assert {r.status for r in short} == {"too_short"} and short[0].yhat == pytest.approx(2.0)


def test_order_search_prefers_the_simple_true_model(spark, spec):
    df = make_series(spark, {"a": ar_series(0.8, 600, 11)}, 1950)
    row = forecast.arima_order_search(df, spec).first()
    assert row.d == 0 and row.p + row.q <= 4


def test_trend_seasonal_matches_penalised_least_squares(spark, spec):
    shape = forecast.TrendSeason()
    n = 60
    y = np.array([50 + 0.5 * i + 5 * math.cos(2 * math.pi * i / 12) for i in range(n)])
    fit = forecast.fit_trend_seasonal(make_series(spark, {"a": y}), spec).first()
    i = np.arange(n)
    t = i / n
    cols = [np.ones(n), t] + [np.maximum(t - 0.8 * (c + 1) / 11, 0) for c in range(10)]
    for k in range(1, 6):
        cols += [np.sin(2 * np.pi * k * i / 12), np.cos(2 * np.pi * k * i / 12)]
    x = np.array(cols).T
    beta = np.linalg.solve(x.T @ x + np.diag(shape.penalties(spec)), x.T @ (y / y.max()))
    assert np.allclose(fit.coef, beta, atol=1e-8)
    ahead = values_of(forecast.forecast_trend_seasonal(make_series(spark, {"a": y}), spec, 12), "yhat")["a"]
    want = [50 + 0.5 * i + 5 * math.cos(2 * math.pi * i / 12) for i in range(n, n + 12)]
    assert np.allclose(ahead, want, rtol=0.03)


def test_scenario_projection(spark, spec):
    df = make_series(spark, {"a": [100.0] * 8}, 2020)  # last month is August
    rows = forecast.scenario_projection(df, spec, (("s", 0.1, True, 0.05),), 4).orderBy("step").collect()
    assert rows[0].yhat == pytest.approx(round(100 * 1.1 * 1.05, 2))
    assert rows[1].yhat == pytest.approx(round(100 * 1.1**2 * 1.15 * 1.05, 2))
    assert rows[0].peak == rows[3].yhat and rows[0].peak_month == "Dec"
    assert rows[0].total == pytest.approx(sum(r.yhat for r in rows))


def test_folds_never_train_on_the_future(spark, spec):
    folds = evaluate.walk_forward_folds(make_series(spark, {"a": range(80), "short": range(30)}), spec).collect()
    assert {r.key for r in folds} == {"a"}
    for k in {r.fold for r in folds}:
        train = [r.date for r in folds if r.fold == k and r.part == "train"]
        test = [r.date for r in folds if r.fold == k and r.part == "test"]
        assert len(test) == 12 and len(train) >= 24 and max(train) < min(test)


def test_metrics_skip_zero_actuals_and_constant_series(spark, spec):
    rows = [("a", "m", dt.date(2020, i + 1, 1), y, h) for i, (y, h) in enumerate([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)])]
    rows += [("z", "m", dt.date(2020, i + 1, 1), 0.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, model string, date date, y double, yhat double")
    out = {r.key: r for r in evaluate.regression_metrics(df, spec).collect()}
    assert out["a"].mape == pytest.approx((0.5 + 0.25) / 2 * 100) and out["a"].rmse == 1.0
    assert out["z"].mape == 0.0 and out["z"].r2 is None


def test_ensemble_weights_and_missing_model(spark, spec):
    metrics = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "w", 3.0)], "key string, model string, rmse double")
    weights = ensemble.inverse_rmse_weights(metrics, spec).collect()
    assert sum(r.weight for r in weights) == pytest.approx(1.0)
    ahead = spark.createDataFrame(
        [("a", "x", dt.date(2020, 1, 1), 10.0), ("a", "y", dt.date(2020, 1, 1), 20.0)], "key string, model string, date date, yhat double"
    )
    # the third model has no forecast: the weights present are renormalised
    assert ensemble.ensemble_inverse_rmse(ahead, metrics, spec).first().yhat == pytest.approx((10 * 1 + 20 / 3) / (1 + 1 / 3))
    assert ensemble.ensemble_inverse_rmse(ahead.where("model = 'x'"), metrics, spec).count() == 0


def trending(spark, keys=4, n=60):
    rng = np.random.default_rng(2)
    return make_series(
        spark, {f"k{k}": [20 + k + 0.4 * i + 3 * math.sin(2 * math.pi * i / 12) + rng.normal() * 0.2 for i in range(n)] for k in range(keys)}
    )


def test_ridge_equals_scaled_closed_form(spark, spec):
    train = ml.model_rows(trending(spark), spec)
    model = ml.fit_ridge(train, 1.0)
    rows = train.collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    keep = x.std(axis=0) > 1e-12
    z = (x[:, keep] - x[:, keep].mean(axis=0)) / x[:, keep].std(axis=0)
    beta = np.linalg.solve(z.T @ z + np.eye(keep.sum()), z.T @ (y - y.mean()))
    got = [r.yhat for r in ml.predict(model, train.coalesce(1), spec, "ridge").collect()]
    assert np.allclose(sorted(got), sorted(z @ beta + y.mean()), atol=1e-4)


def test_recursive_forecast_equals_appending_predictions(spark, spec):
    df = trending(spark, 2)
    model = ml.fit_ridge(ml.model_rows(df, spec))
    got = values_of(ml.forecast_recursive(model, df, spec, 3), "yhat")
    grown = df
    for step in range(3):
        nxt = prepare.future_calendar(grown, spec, 1).select("key", "date").withColumn("y", F.lit(0.0))
        rows = ml.model_rows(grown.unionByName(nxt), spec).where("age = 1")
        scored = model.copy().setPredictionCol("yhat").transform(rows).select("key", "date", F.col("yhat").alias("y"))
        grown = spark.createDataFrame(grown.unionByName(scored).collect(), "key string, date date, y double")
    want = {k: v[-3:] for k, v in values_of(grown).items()}
    for k in want:
        assert np.allclose(got[k], want[k])


def test_permutation_importance_uses_every_value_once_and_finds_signal(spark, spec):
    df = trending(spark)
    rows = ml.model_rows(df, spec)
    model = ml.fit_ridge(rows)
    out = {r.feature: r.importance for r in ml.permutation_importance(model, rows, spec, repeats=20).collect()}
    assert set(out) == set(ml.feature_names())
    # a linear model loses 2 beta^2 var(x) / var(y) when x is shuffled (residuals are small here)
    x = np.array([r.features.toArray() for r in rows.collect()])
    y = np.array([r.label for r in rows.collect()])
    want = 2 * model.coefficients.toArray() ** 2 * x.var(axis=0) / y.var()
    for j in np.argsort(want)[-3:]:
        assert out[ml.feature_names()[j]] == pytest.approx(want[j], rel=0.35)


def test_versions_survive_a_failed_save(spark, spec, tmp_path):
    root = str(tmp_path / "store")
    df = trending(spark, 1, 20)
    first = versions.save_version(df, root, spec, "test", dt.datetime(2026, 1, 1))
    # rows without a registry entry, as a crash would leave them
    df.limit(3).write.parquet(f"{root}/rows/batch=broken")
    assert versions.load_latest_version(spark, root, spec).count() == 20
    again = versions.save_version(df.orderBy(F.desc("date")), root, spec, "test", dt.datetime(2026, 1, 2))
    assert first[-8:] == again[-8:], "the hash must not depend on row order"
    assert versions.version_info(spark, root).first().version == again


def test_model_registry_round_trip(spark, spec, tmp_path):
    rows = ml.model_rows(trending(spark, 1), spec)
    model = ml.fit_ridge(rows)
    for day in (1, 2):
        models.save_model(model, str(tmp_path), "ridge", dt.datetime(2026, 1, day), ml.feature_names(), ("a", "b"), {"rmse": 1.0})
    loaded = models.load_model(spark, str(tmp_path), "ridge")
    assert np.allclose(loaded.coefficients.toArray(), model.coefficients.toArray())
    assert models.model_registry(spark, str(tmp_path)).where("is_active").count() == 1


def test_ridge_of_every_fold_equals_a_fit_of_its_own(spark, spec):
    from tidemill.operators import folds

    rows = folds.with_folds(ml.model_rows(trending(spark, 3, 110).unionByName(make_series(spark, {"short": range(30, 70)})), spec)).cache()
    fits = {r.fold: r for r in folds.ridge_by_fold(rows).collect()}
    assert sorted(fits) == [1, 2, 3, 4, 5]
    for k, fit in fits.items():
        one = ml.fit_ridge(rows.where(F.col("first_fold") <= k).coalesce(1))
        got = [(r.yhat, r.own) for r in ml.predict(one, rows.where(F.col("test_fold") == k), spec, "x").withColumnRenamed("yhat", "own")
               .join(folds.ridge_fold_predictions(rows, spec).drop("y", "model"), spec.ids).collect()]
        assert len(got) >= 36 and all(a == pytest.approx(b, rel=1e-5) for a, b in got)


def test_folds_of_rows_are_those_of_the_series(spark, spec):
    from tidemill.operators import folds

    df = make_series(spark, {"a": range(1, 100), "b": range(1, 50), "c": range(1, 37), "d": range(1, 30)})
    want = {}
    for r in evaluate.walk_forward_folds(df, spec).collect():
        want.setdefault((r.key, r.date), set()).add((r.fold, r.part))
    for r in folds.with_folds(ml.model_rows(df, spec)).collect():
        train = {(k, "train") for k in range(r.first_fold, 6)} if r.first_fold else set()
        assert train | ({(r.test_fold, "test")} if r.test_fold else set()) == want.get((r.key, r.date), set())


def test_walk_forward_by_series_and_feature_models(spark, spec):
    df = trending(spark, 3, 100)
    models = ("moving_average", "arima", "sarima", "trend_seasonal", "ridge")
    cv = evaluate.walk_forward_cv(df, spec, n_splits=3, models=models).collect()
    assert len(cv) == 15 and all(r.n_splits == 3 and r.mean_rmse > 0 for r in cv)


@pytest.mark.parametrize("fit", [lambda t: ml.fit_random_forest(t, trees=4), lambda t: ml.fit_gbt(t, trees=4, depth=3)])
def test_a_seed_means_the_same_trees_however_rows_are_partitioned(spark, spec, fit):
    rows = ml.model_rows(trending(spark, 12, 80), spec).cache()
    trees = {fit(rows.repartition(n)).toDebugString.split("\n", 1)[1] for n in (1, 4, 32)}
    assert len(trees) == 1


def test_keyed_permutations_are_bijections_and_differ():
    from tidemill.operators.shuffles import permuted

    for n in (1, 2, 3, 4, 5, 100, 4097, 100_001):
        seen = [permuted(np.arange(n), np.full(n, key), n) for key in (1, 2)]
        assert all(sorted(s.tolist()) == list(range(n)) for s in seen)
        if n >= 100:
            assert (seen[0] == seen[1]).mean() < 0.1 and (seen[0] == np.arange(n)).mean() < 0.1
            assert abs(np.corrcoef(seen[0], np.arange(n))[0, 1]) < 0.3


@pytest.mark.parametrize("n", [10_000, 150_000])
def test_ranks_do_not_depend_on_partitions(spark, n):
    from tidemill.operators.shuffles import with_rank

    rows = spark.range(n).select(F.col("id"), (F.col("id") % 7).cast("string").alias("k"))
    sums = set()
    for parts in (1, 9, 40):
        ranked = with_rank(rows.repartition(parts), ["k", "id"])
        total = ranked.agg(F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.sum(F.xxhash64("k", "id", "rank").cast("decimal(38,0)")).alias("s")).first()
        assert (total.d, total.m) == (n, n - 1)
        sums.add(total.s)
    assert len(sums) == 1


def test_permutation_importance_equals_numpy_with_the_same_permutation(spark, spec):
    from tidemill.operators.shuffles import permuted, with_rank

    rows = ml.model_rows(trending(spark, 3, 40), spec)
    model = ml.fit_ridge(rows)
    ranked = sorted(with_rank(rows, spec.ids, "rank").collect(), key=lambda r: r["rank"])
    x, y = np.array([r.features.toArray() for r in ranked]), np.array([r.label for r in ranked])
    score = lambda z: 1 - ((y - z @ model.coefficients.toArray() - model.intercept) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    want = {}
    for j, name in enumerate(ml.feature_names()):
        drops = []
        for repeat in (1, 2, 3):
            z = x.copy()
            z[:, j] = x[permuted(np.arange(len(x)), np.full(len(x), 7 * 1_000_003 + repeat), len(x)), j]
            drops.append(score(x) - score(z))
        want[name] = (np.mean(drops), np.std(drops))
    for parts in (1, 11):
        got = {r.feature: (r.importance, r.importance_std) for r in ml.permutation_importance(model, rows.repartition(parts), spec, 3, seed=7).collect()}
        assert all(got[f] == pytest.approx(want[f], abs=1e-8) for f in want)


def test_importance_comes_from_the_fitted_models(spark, spec):
    from tidemill.operators import explain

    rows = ml.model_rows(trending(spark, 4, 70), spec).cache()
    models = {"ridge": ml.fit_ridge(rows), "forest": ml.fit_random_forest(rows, trees=5)}
    out = {(r.model, r.feature): r.importance for r in ml.fitted_importance(models, rows).collect()}
    x = np.array([r.features.toArray() for r in rows.collect()])
    want = np.abs(models["ridge"].coefficients.toArray()) * x.std(axis=0, ddof=1)
    names = ml.feature_names()
    assert [out["ridge", f] for f in names] == pytest.approx((want / want.sum()).tolist())
    assert [out["forest", f] for f in names] == pytest.approx(models["forest"].featureImportances.toArray().tolist())
    ranked = explain.importance_ranked(ml.fitted_importance(models, rows), ["model"]).collect()
    assert {r.model for r in ranked if r["rank"] == 1} == {"ridge", "forest"} and len(ranked) == 2 * len(names)
    over = explain.importance_over_models(ml.fitted_importance(models, rows)).collect()
    assert len(over) == 10 and all(r.models == 2 for r in over)


def test_interleaved_saves_keep_all_versions_and_the_last_commit_wins(spark, spec, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidemill.sources.commits import claim_number

    root = str(tmp_path / "store")
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda _: claim_number(spark, root), range(24)))
    assert sorted(taken) == list(range(1, 25))
    save = lambda n: versions.save_version(trending(spark, 1, n), root, spec, f"w{n}", dt.datetime(2026, 1, 1), csv_copy=False)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(save, (20, 30)))
    rows = spark.read.schema(versions.REGISTRY).parquet(f"{root}/registry").collect()
    assert {r.source for r in rows} == {"w20", "w30"} and {r.number for r in rows} == {25, 26}
    last = max(rows, key=lambda r: r.number)
    assert versions.version_info(spark, root).first().source == last.source
    assert versions.load_latest_version(spark, root, spec).count() == last.record_count
    # a later commit is the newest whatever its time says
    versions.save_version(trending(spark, 1, 9), root, spec, "late", dt.datetime(2020, 1, 1), csv_copy=False)
    assert versions.version_info(spark, root).first().source == "late"
