"""No size or gap may change a result silently."""

import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from series_rows import make_series, values_of
from pyspark.sql import functions as F

from tidemill.functions.columns import stable_round
from tidemill.operators import describe, features, forecast, prepare, stattests
from tidemill.operators.rollup import exact_sum
from tidemill.sources import html


def test_rounding_of_large_values(spark):
    values = [1.5, 1e14, -1e14, 1e20, -3e300, 0.1234565, float("nan")]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(stable_round(F.col("x")).alias("x")).collect()]
    assert got[:6] == [1.5, 1e14, -1e14, 1e20, -3e300, 0.123457] and math.isnan(got[6])


def test_sums_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(0.004,), (0.004,), (1e16,)], "x double")
    assert df.where("x < 1").agg(exact_sum(F.col("x"))).first()[0] == 0.008
    assert df.agg(exact_sum(F.col("x"))).first()[0] == 1e16
    assert float(df.agg(exact_sum(F.col("x"), 3, 38)).first()[0]) == 1e16 + 0.008


def slow_adf(y):
    """Regressions by lstsq on explicit rows."""
    n = len(y)
    d = np.diff(y)
    largest = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lag, start):
        rows = range(start, n - 1)
        x = np.array([[y[t], 1.0, *(d[t - k] for k in range(1, lag + 1))] for t in rows])
        beta, *_ = np.linalg.lstsq(x, d[start:], rcond=None)
        return x, beta, ((d[start:] - x @ beta) ** 2).sum()

    def aic(lag):
        sse, obs = fit(lag, largest)[2], n - 1 - largest
        return obs * (math.log(2 * math.pi) + math.log(sse / obs) + 1) + 2 * (2 + lag)

    best = min(range(largest + 1), key=aic)
    x, beta, sse = fit(best, best)
    return beta[0] / math.sqrt(sse / (len(x) - len(beta)) * np.linalg.inv(x.T @ x)[0, 0]), best, len(x)


def test_adf_lag_order_is_not_cut():
    rng = np.random.default_rng(3)
    y = np.zeros(5000)
    for t in range(1, 5000):  # a far lag, beyond 24, carries weight
        y[t] = 0.5 * y[t - 1] + (0.45 * y[t - 30] if t >= 30 else 0) + rng.normal()
    stat, lag, nobs = stattests.adf_fit(y)
    want = slow_adf(y)
    assert lag == want[1] > 24 and nobs == want[2] and abs(stat - want[0]) < 1e-6 * abs(want[0])


def test_adf_leaves_missing_values_out():
    rng = np.random.default_rng(4)
    y = rng.normal(size=120).cumsum()
    y[[30, 31, 70]] = np.nan
    stat, lag, nobs = stattests.adf_fit(y)
    d = np.diff(y)
    rows = [t for t in range(lag, 119) if np.isfinite([y[t], d[t], *(d[t - k] for k in range(1, lag + 1))]).all()]
    x = np.array([[y[t], 1.0, *(d[t - k] for k in range(1, lag + 1))] for t in rows])
    beta, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
    sse = ((d[rows] - x @ beta) ** 2).sum()
    assert nobs == len(rows)
    assert abs(stat - beta[0] / math.sqrt(sse / (nobs - len(beta)) * np.linalg.inv(x.T @ x)[0, 0])) < 1e-8
    assert stattests.adf_fit(np.full(5, np.nan)) == (None, None, 0)


def test_exponential_means_of_long_spans(spark, spec):
    rng = random.Random(1)
    y = [rng.gauss(100, 20) for _ in range(600)]
    got = features.ewm_features(make_series(spark, {"a": y}, 1960), spec, [3, 26, 400])
    for s in (3, 26, 400):
        mean, want = y[0], [None]
        for v in y[1:]:
            want.append(mean)
            mean += 2.0 / (s + 1) * (v - mean)
        have = values_of(got, f"ema_{s}")["a"]
        assert have[0] is None and np.allclose(have[1:], want[1:], rtol=1e-12)


def test_shapiro_beyond_its_p_value(spark, spec):
    rng = random.Random(2)
    y = [rng.gauss(0, 1) for _ in range(6000)]
    row = describe.shapiro_wilk(make_series(spark, {"a": y}, 1500), spec).first()
    assert row.n == 6000 and row.w > 0.99 and row.p_value is None and row.is_normal is None


def test_arma_fit_leaves_gaps_out(spark, spec):
    rng = np.random.default_rng(5)
    w = np.zeros(140)
    for t in range(2, 140):
        w[t] = 0.6 * w[t - 1] - 0.3 * w[t - 2] + rng.normal()
    y = w.tolist()
    y[50] = y[90] = None
    shape = forecast.ArmaShape((), (1, 2), ())
    row = forecast.fit_arma(make_series(spark, {"a": y}, 2000), spec, shape).first()
    v = np.array([np.nan if x is None else x for x in y])
    start = max(shape.ar)
    rows = [t for t in range(start, 140) if np.isfinite(v[[t, t - 1, t - 2]]).all()]
    x = np.array([[v[t - 1], v[t - 2], 1.0] for t in rows])
    beta, *_ = np.linalg.lstsq(x, v[rows], rcond=None)
    assert row.nobs == len(rows) and row.status == "ok" and np.allclose(row.coef, beta, atol=1e-6)


def test_tables_nested_and_left_open(spark):
    row = "<tr><td>Jan 2020</td><td>{}M</td><td>2</td></tr>"
    pages = {
        1: "<table><tr><th>h</th></tr>" + row.format(1) + "</table>" + row.format(9),
        2: "<TABLE class=x><tr></tr>" + row.format(2),
        3: "<table><tr></tr>" + row.format(3) + "<table>" + row.format(8) + "</table></table>",
        4: "no table",
        5: None,
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = html.first_table_rows(df)
    assert sorted((r.page_id, r.row_no, r.volume) for r in got.collect()) == [(1, 1, 1.0), (2, 1, 2.0), (3, 1, 3.0)]
    assert got._jdf.queryExecution().executedPlan().toString().split("\n\n")[0].count("regexp_extract_all") <= 3


def test_rows_of_nested_tables_stay_apart(spark):
    cells = "<tr><td>{}</td><td>{}</td></tr>"
    inner = "<table><tr><th>Month</th></tr>" + cells.format("in", 1) + "</table>"
    pages = {
        1: "<table><tr><th>name</th></tr>" + cells.format("a", 1) + "<tr><td>x" + inner + "y</td><td>2</td></tr>" + cells.format("b", 3) + "</table>" + inner,
        2: "<table><tr><th>volume</th></tr>" + cells.format("a", "1 < 2 <b>3</b>") + "<table>" + cells.format("c", 4),
        3: "<TABLE><TR><TH>Month<TD>v<TR><TD> p\n\t q <TD>&lt;5&gt;</TBODY><TR><TD>r<TD>6</TABLE>",
        4: "<table></table>",
        5: "",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    tables = df.select("page_id", html._tables(df.html).alias("t")).orderBy("page_id")
    assert [len(r.t or []) for r in tables.collect()] == [3, 2, 1, 1, 0]
    rows = [[list(c) for c in r.r] for r in tables.where("page_id <= 3").select(html._rows(F.col("t")[0]).alias("r")).collect()]
    assert rows[0] == [["name"], ["a", "1"], ["xy", "2"], ["b", "3"]]
    assert rows[1] == [["volume"], ["a", "1 < 2 3"]]
    assert rows[2] == [["Month", "v"], ["p q", "<5>"], ["r", "6"]]
    got = sorted((r.page_id, r.row_no, r.cells) for r in html.matching_table_rows(df).collect())
    assert got == [(1, 0, ["in", "1"]), (2, 0, ["a", "1 < 2 3"]), (3, 0, ["p q", "<5>"]), (3, 1, ["r", "6"])]


def test_dedupe_ties_and_missing_order(spark, spec):
    import datetime as dt

    t = dt.date(2020, 1, 1)
    rows = [("a", t, 1.0, 5), ("a", t, 2.0, 5), ("a", t, 9.0, None), ("b", t, 3.0, None)]
    df = spark.createDataFrame(rows, "key string, date date, y double, seq int")
    got = sorted((r.key, r.y, r.seq) for r in prepare.dedupe_keep_last(df, spec, "seq").collect())
    assert got == [("a", 2.0, 5), ("b", 3.0, None)]


def test_package_reaches_workers_from_another_folder(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from tidemill.session import build_session
from tidemill.plans import all_queries
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false")
print("rows", all_queries.QUERIES["adf_test"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]


def test_short_series_keep_their_rows(spark, spec):
    """Every key of the input is in the result, with nulls and a reason."""
    from tidemill.operators import evaluate, ml

    y = [100.0 + 10 * math.sin(k) + k for k in range(80)]
    gappy = y[:70] + [None] + y[71:]
    df = make_series(spark, {"long": y, "short": y[:6], "gap": gappy, "none": [None] * 20})
    cv = {(r.key, r.model): r for r in evaluate.walk_forward_cv(df, spec).collect()}
    assert len(cv) == 8 and cv["short", "arima"].n_splits == 0 and cv["short", "arima"].mean_rmse is None
    assert cv["long", "moving_average"].n_splits == 4
    orders = {r.key: r.status for r in forecast.arima_order_search(df, spec, 2, 1, 2).collect()}
    assert orders == {"long": "ok", "short": "too_short", "gap": "ok", "none": "too_short"}
    assert {r.key for r in forecast.forecast_trend_seasonal(df, spec, 3).collect()} == {"long", "short", "gap", "none"}
    rows = ml.model_rows(make_series(spark, {"long": y}), spec)
    ahead = ml.forecast_recursive(ml.fit_ridge(rows), df, spec, 2).collect()
    assert {(r.key, r.status) for r in ahead} == {("long", "ok"), ("short", "too_short"), ("gap", "too_short"), ("none", "too_short")}
    few = df.where("key in ('long', 'short')").select("key", "date", "y", F.lit("m").alias("model"), (F.col("y") + 1).alias("yhat"))
    for check in (evaluate.runs_test, evaluate.heteroscedasticity):
        got = {r.key: r.interpretation for r in check(few, spec).collect()}
        assert got["short"] == "Insufficient data" != got["long"]
    two = few.where("date < '2015-03-01'")
    assert {r.interpretation for r in evaluate.residual_normality(two, spec).collect()} == {"Insufficient data"}


def test_failed_fits_are_counted_and_not_scored(spark, spec):
    from tidemill.operators import evaluate, model_set

    y = [100.0 + 10 * math.sin(k) + k for k in range(90)]
    df = make_series(spark, {"long": y, "short": y[:20]})
    names = ("moving_average", "arima", "sarima", "trend_seasonal")
    failed = {r.model: (r.series, r.failed) for r in model_set.failed_fits(df, model_set.forecasts(df, spec, 3, names), spec, names).collect()}
    assert failed["moving_average"] == (2, 0) and failed["sarima"] == (2, 1)
    got = {(r.key, r.model) for r in evaluate.evaluate_all_models(df, spec, 6, ("moving_average", "sarima", "ridge")).collect()}
    assert ("short", "sarima") not in got and {("long", "sarima"), ("long", "ridge"), ("short", "moving_average")} <= got
