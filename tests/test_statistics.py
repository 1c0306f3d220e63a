import math
import statistics

import numpy as np
import pytest
from series_rows import make_series, values_of
from pyspark.sql import functions as F

from tidemill.functions import distributions as dist
from tidemill.operators import anomaly, describe, features, stattests


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normal_functions_match_the_standard_library(spark):
    n = statistics.NormalDist()
    zs = [-9.0, -6.5, -3.0, -0.7, 0.0, 0.3, 1.96, 4.0, 8.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(dist.normal_cdf(F.col("z")).alias("v")).collect()
    assert np.allclose([r.v for r in got], [n.cdf(z) for z in zs], rtol=1e-9, atol=1e-14)
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.5, 0.8, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(dist.normal_ppf(F.col("p")).alias("v")).collect()
    assert np.allclose([r.v for r in got], [n.inv_cdf(p) for p in ps], rtol=1e-12)
    assert one(spark, dist.normal_ppf(F.lit(0.0))) is None


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 7, 30, 75])
def test_student_tail_matches_integration(spark, dof):
    t = 1.7
    x = np.linspace(0, t, 200_001)
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    inside = 2 * np.trapezoid(c * (1 + x**2 / dof) ** (-(dof + 1) / 2), x)
    assert one(spark, dist.student_two_sided(F.lit(-t), F.lit(dof))) == pytest.approx(1 - inside, abs=1e-8)


def test_chi2_tail(spark):
    # 5 % points of chi-square with 2 and 12 degrees of freedom
    assert one(spark, dist.chi2_tail_even(F.lit(5.991465), 2)) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, dist.chi2_tail_even(F.lit(21.026070), 12)) == pytest.approx(0.05, abs=1e-6)


def test_shapiro_wilk_on_the_published_sample(spark, spec):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = describe.shapiro_wilk(make_series(spark, {"w": weights}), spec).first()
    assert row.w == pytest.approx(0.79, abs=0.005)
    assert row.p_value == pytest.approx(0.0067, abs=0.0005)
    gauss = [statistics.NormalDist().inv_cdf((i + 0.5) / 60) for i in range(60)]
    row = describe.shapiro_wilk(make_series(spark, {"g": gauss}), spec).first()
    assert row.w > 0.99 and row.is_normal


def ar_series(phi, n=200, seed=3):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + rng.normal()
    return y


def test_acf_and_pacf_match_direct_formulas(spark, spec):
    y = ar_series(0.7)
    df = make_series(spark, {"a": y}, 1990)
    d = y - y.mean()
    want = [np.dot(d[k:], d[: len(d) - k]) / np.dot(d, d) for k in range(25)]
    assert np.allclose([r.acf for r in sorted(stattests.acf(df, spec).collect(), key=lambda r: r.lag)], want)
    pacf = []
    for k in range(1, 25):
        r = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        pacf.append(np.linalg.solve(r, want[1 : k + 1])[-1])
    got = sorted(stattests.pacf(df, spec).collect(), key=lambda r: r.lag)
    assert np.allclose([r.pacf for r in got], [1.0, *pacf])


def adf_by_hand(y, maxlag):
    dy = np.diff(y)

    def fit(lag, start):
        rows = range(start, len(y))
        x = np.array([[y[t - 1], 1.0, *[dy[t - 1 - k] for k in range(1, lag + 1)]] for t in rows])
        z = np.array([dy[t - 1] for t in rows])
        beta, *_ = np.linalg.lstsq(x, z, rcond=None)
        sse = ((z - x @ beta) ** 2).sum()
        return beta, sse, x, len(z)

    def aic(lag):
        _, sse, x, n = fit(lag, maxlag + 1)
        return n * (math.log(2 * math.pi) + math.log(sse / n) + 1) + 2 * x.shape[1]

    lag = min(range(maxlag + 1), key=aic)
    beta, sse, x, n = fit(lag, lag + 1)
    se = math.sqrt(sse / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    return beta[0] / se, lag


@pytest.mark.parametrize("phi, stationary", [(0.4, True), (1.0, False)])
def test_adf_matches_ordinary_regression(spark, spec, phi, stationary):
    y = ar_series(phi, 150) + 5
    maxlag = math.ceil(12 * (150 / 100) ** 0.25)
    stat, lag = adf_by_hand(y, maxlag)
    row = stattests.adf_test(make_series(spark, {"a": y}, 1990), spec).first()
    assert row.lags_used == lag
    assert row.adf_stat == pytest.approx(stat, rel=1e-6)
    assert row.is_stationary is stationary


def test_adf_p_value_at_the_critical_value(spark, spec):
    # MacKinnon: -2.86 is the asymptotic 5 % point
    p = one(spark, dist.normal_cdf(stattests._powers(F.lit(-2.86154), stattests.ADF_SMALL_P)))
    assert p == pytest.approx(0.05, abs=0.001)


def test_kpss_verdicts_and_flat_series(spark, spec):
    df = make_series(spark, {"noise": ar_series(0.0, 120), "walk": ar_series(1.0, 120), "flat": [3.0] * 40}, 1990)
    out = {r.key: r for r in stattests.kpss_test(df, spec).collect()}
    assert out["noise"].is_stationary and not out["walk"].is_stationary
    assert out["flat"].kpss_stat is None


def test_short_and_flat_series_give_nulls_not_errors(spark, spec):
    df = make_series(spark, {"one": [1.0], "two": [1.0, 2.0], "five": [1, 2, 3, 2, 1], "flat": [2.0] * 13, "zero": [0.0] * 14})
    for fn in (
        describe.series_summary, describe.distribution_stats, describe.skew_kurt, describe.jarque_bera, describe.shapiro_wilk,
        describe.trend_type, describe.trend_cubic, describe.seasonal_strength, describe.growth_trajectory, describe.growth_insights,
        stattests.acf_interpretation, stattests.kpss_test, stattests.adf_test, stattests.stationarity_verdict,
        features.trend_direction, describe.cagr, describe.histogram_density, describe.qq_points,
    ):
        fn(df, spec).collect()
    features.create_features(df, spec).collect()


def test_decomposition_parts_multiply_back(spark, spec):
    y = [(10 + i) * (1 + 0.2 * math.sin(i * math.pi / 6)) for i in range(48)]
    rows = features.decompose(make_series(spark, {"a": y}), spec).where("decomp_trend is not null").collect()
    assert len(rows) == 36
    for r in rows:
        assert r.decomp_trend * r.decomp_seasonal * r.decomp_resid == pytest.approx(r.y)


def test_scaling_leaves_z_scores_alone(spark, spec):
    y = [5, 6, 5, 7, 30, 6, 5, 6, 7, 5, 6, 7]
    a = values_of(anomaly.anomaly_combined(make_series(spark, {"a": y}), spec), "z_score")["a"]
    b = values_of(anomaly.anomaly_combined(make_series(spark, {"a": [v * 1000 for v in y]}), spec), "z_score")["a"]
    assert np.allclose(a, b)
    flat = anomaly.zscore_pop(make_series(spark, {"f": [4.0] * 5}), spec)
    assert values_of(flat, "z_score")["f"] == [0.0] * 5


def test_severity_thresholds_are_strict(spark):
    zs = [2.0, 2.01, 2.5, 2.51, 3.0, 3.01, 3.5, 3.51]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select(anomaly.severity_ladder(F.col("z")).alias("s"))
    assert [r.s for r in df.collect()] == ["normal", "low", "low", "medium", "medium", "high", "high", "critical"]


def test_ewm_on_a_long_series_matches_the_recursion(spark, spec):
    y = ar_series(0.9, 600)
    df = make_series(spark, {"a": y}, 1950)
    got = values_of(features.ewm_features(df, spec, [3, 12]), "ema_12")["a"]
    want, alpha = [y[0]], 2 / 13
    for v in y[1:-1]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    assert got[0] is None and np.allclose(got[1:], want, rtol=1e-12)
