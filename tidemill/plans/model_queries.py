"""Forecasts, ensembles, intervals, evaluation and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import anomaly, describe, ensemble, evaluate, forecast, model_set, prepare
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs
from tidemill.plans.sqlmath import cdf, poly, ppf
from tidemill.session import cut_lineage

SEG = tb.SEGMENT
GREC = f"WITH RECURSIVE {tb.SEGMENT_GRID_SQL}"
G = f"WITH {tb.SEGMENT_GRID_SQL}"
WINDOWS = (3, 6, 12)
TEST = 12


def series(spark, folder) -> DataFrame:
    return tb.segment_grid(spark, folder).drop("n")


def averages(df: DataFrame, spec=SEG, horizon: int = 12) -> DataFrame:
    """Moving-average forecasts with three window lengths, as three models."""
    return forecast.forecast_moving_averages(df, spec, WINDOWS, horizon)


def backtest_of(df: DataFrame) -> DataFrame:
    """Forecasts of the last year from the rows before it, with the values that came true."""
    marked = prepare.split_last_n(df, SEG, TEST)
    train = marked.where(F.col("split") == "train").drop("split")
    test = marked.where(F.col("split") == "test").select("segment", "date", "y")
    return averages(train).join(test, ["segment", "date"])


def backtest(spark, folder) -> DataFrame:
    return backtest_of(series(spark, folder))


def one_step(spark, folder) -> DataFrame:
    return forecast.one_step_average(series(spark, folder), SEG, WINDOWS)


def backtest_metrics(spark, folder) -> DataFrame:
    return evaluate.regression_metrics(backtest(spark, folder), SEG)


def averages_cte(name: str, skip: int = 0, horizon: int = 12) -> str:
    """Recursive moving averages from the rows older than the newest ``skip``."""
    return f""",
{name}_past AS (SELECT segment, list(y ORDER BY i) AS ys, MAX(date) AS last FROM g WHERE i < len - {skip} GROUP BY 1),
{name}_rec AS (
  SELECT segment, last, w, 0 AS step, ys[-w:] AS tail, CAST(NULL AS DOUBLE) AS yhat FROM {name}_past, (VALUES (3), (6), (12)) v(w)
  UNION ALL
  SELECT segment, last, w, step + 1, list_append(tail[2:], list_sum(tail) / len(tail)), list_sum(tail) / len(tail)
  FROM {name}_rec WHERE step < {horizon}),
{name} AS (SELECT segment, 'ma_' || w AS model, CAST(step AS BIGINT) AS step, CAST(last + to_months(step) AS DATE) AS date, yhat
           FROM {name}_rec WHERE step > 0)
"""


FC = averages_cte("fc")
BT = averages_cte("fb", TEST) + """,
bt AS (SELECT fb.*, g.y FROM fb JOIN g ON g.segment = fb.segment AND g.date = fb.date)
"""


def metrics_cte(source: str, name: str, by: str = "segment, model") -> str:
    return f""",
{name} AS (SELECT {by}, sqrt(AVG(pow(y - yhat, 2))) AS rmse, AVG(ABS(y - yhat)) AS mae,
       COALESCE(AVG(ABS(y - yhat) / ABS(NULLIF(y, 0))) * 100, 0) AS mape,
       1 - SUM(pow(y - yhat, 2)) / NULLIF(VAR_POP(y) * COUNT(*), 0) AS r2, STDDEV_POP(ABS(y - yhat)) AS std_error, COUNT(*) AS n
       FROM {source} GROUP BY ALL)
"""


BM = BT + metrics_cte("bt", "bm")

ONE = """,
os AS (""" + " UNION ALL ".join(
    f"""SELECT segment, date, i, 'ma_{w}' AS model, y, AVG(y) OVER (PARTITION BY segment ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS yhat,
        COUNT(y) OVER (PARTITION BY segment ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS c, {w} AS w FROM g"""
    for w in WINDOWS
) + """),
p AS (SELECT segment, date, model, y, yhat, y - yhat AS e, row_number() OVER (PARTITION BY segment, model ORDER BY date) - 1 AS j,
             COUNT(*) OVER (PARTITION BY segment, model) AS m FROM os WHERE c = w)
"""


# -- forecasts ---------------------------------------------------------------


@query("forecast_moving_average", f"{GREC}{FC} SELECT segment, model, step, date, {rs('yhat')} FROM fc")
def forecast_moving_average(spark, folder):
    return averages(series(spark, folder))


@query("forecast_arima")
def forecast_arima(spark, folder):
    return forecast.forecast_arima(series(spark, folder), SEG)


@query("forecast_sarima")
def forecast_sarima(spark, folder):
    return forecast.forecast_sarima(series(spark, folder), SEG)


@query("arima_order_search")
def arima_order_search(spark, folder):
    return forecast.arima_order_search(series(spark, folder), SEG)


@query("forecast_trend_seasonal")
def forecast_trend_seasonal(spark, folder):
    return forecast.forecast_trend_seasonal(series(spark, folder), SEG)


@query("trend_seasonal_components")
def trend_seasonal_components(spark, folder):
    return forecast.trend_seasonal_components(series(spark, folder), SEG)


PRESETS_SQL = """(VALUES ('Conservative', 0.03e0, TRUE, 0e0), ('Moderate', 0.08e0, TRUE, 0.05e0),
  ('Aggressive', 0.15e0, TRUE, 0.1e0), ('Festival Special', 0.1e0, TRUE, 0.15e0)) s(scenario, growth, festive, custom)"""
LAST_SQL = "lv AS (SELECT custkey, arg_max(y, date) AS last_value, MAX(date) AS last FROM cust GROUP BY 1)"


@query(
    "scenario_presets",
    f"""WITH {tb.CUSTOMER_SQL}, {LAST_SQL} SELECT custkey, {rs('last_value')}, last, scenario, {rs('growth')}, festive, {rs('custom')}
        FROM lv CROSS JOIN {PRESETS_SQL}""",
)
def scenario_presets(spark, folder):
    return forecast.scenario_presets(tb.customer_series(spark, folder), tb.CUSTOMER)


@query(
    "scenario_projection",
    f"""WITH {tb.CUSTOMER_SQL}, {LAST_SQL},
        pr AS (SELECT custkey, scenario, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS date, last_value, growth, festive, custom
               FROM lv CROSS JOIN {PRESETS_SQL} CROSS JOIN range(1, 13) t(step)),
        v AS (SELECT custkey, scenario, step, date, {r('last_value * pow(1 + growth, step) * CASE WHEN festive AND month(date) IN (10, 11, 12) THEN 1.15e0 ELSE 1e0 END * (1 + custom)', 'yhat', 2)} FROM pr)
        SELECT custkey, scenario, step, date, {rs('yhat')},
               {r(r('SUM(yhat) OVER k', digits=2), 'total')}, {r('MAX(yhat) OVER k', 'peak')},
               strftime(arg_min(date, struct_pack(v := -yhat, s := step)) OVER k, '%b') AS peak_month
        FROM v WINDOW k AS (PARTITION BY custkey, scenario)""",
)
def scenario_projection(spark, folder):
    return forecast.scenario_projection(tb.customer_series(spark, folder), tb.CUSTOMER)


# -- alignment and backtest --------------------------------------------------


@query(
    "align_models",
    f"""{GREC}{FC} SELECT segment, date, {rs(*[f"ma_{w}=MAX(yhat) FILTER (model = 'ma_{w}')" for w in WINDOWS])} FROM fc GROUP BY 1, 2""",
)
def align_models(spark, folder):
    return prepare.align_models(averages(series(spark, folder)), SEG, [f"ma_{w}" for w in WINDOWS])


@query(
    "backtest_join",
    f"""{GREC}{averages_cte('fb', 6)} SELECT fb.segment, model, step, fb.date, {rs('yhat', 'actual=g.y', 'error=g.y - yhat')}
        FROM fb LEFT JOIN g ON g.segment = fb.segment AND g.date = fb.date""",
)
def backtest_join(spark, folder):
    df = series(spark, folder)
    marked = prepare.split_last_n(df, SEG, 6)
    ahead = averages(marked.where(F.col("split") == "train"))
    return prepare.backtest_join(ahead, df, SEG)


@query(
    "history_plus_forecast",
    f"""{GREC}{FC} SELECT segment, date, {rs('y')}, 'history' AS kind, CAST(NULL AS VARCHAR) AS model FROM g
        UNION ALL SELECT segment, date, {r('yhat')}, 'forecast', model FROM fc""",
)
def history_plus_forecast(spark, folder):
    df = series(spark, folder)
    return prepare.history_plus_forecast(df, averages(df), SEG)


@query(
    "deviation_from_expected",
    f"""{G}{ONE} SELECT segment, date, {rs('y', 'expected_value=yhat', 'deviation_percent=(y - yhat) / yhat * 100')},
        ABS((y - yhat) / yhat * 100) > 15 AS is_alert FROM p WHERE model = 'ma_3'""",
)
def deviation_from_expected(spark, folder):
    expected = one_step(spark, folder).where(F.col("model") == "ma_3")
    return anomaly.deviation_from_expected(series(spark, folder), expected, SEG)


# -- metrics -----------------------------------------------------------------

FIVE = ("rmse", "mae", "mape", "r2", "std_error")


@query("regression_metrics", f"{GREC}{BM} SELECT segment, model, {rs(*FIVE)}, n FROM bm")
def regression_metrics(spark, folder):
    return backtest_metrics(spark, folder)


@query(
    "pct_improvement",
    f"""{GREC}{BM} SELECT a.segment, {r('COALESCE((b.rmse - a.rmse) / NULLIF(b.rmse, 0) * 100, 0)', 'improvement')}
        FROM bm a JOIN bm b ON a.segment = b.segment AND a.model = 'ma_12' AND b.model = 'ma_3'""",
)
def pct_improvement(spark, folder):
    wide = evaluate.compare_models_wide(backtest_metrics(spark, folder), SEG, ["ma_3", "ma_12"])
    return wide.select("segment", evaluate.pct_improvement(F.col("ma_3_rmse"), F.col("ma_12_rmse")).alias("improvement"))


@query(
    "residual_stats",
    f"""{G}{ONE} SELECT segment, model, {rs('mean=AVG(e)', 'std=STDDEV_POP(e)', 'min=MIN(e)', 'max=MAX(e)', 'median=MEDIAN(e)')}
        FROM p GROUP BY 1, 2""",
)
def residual_stats(spark, folder):
    return evaluate.residual_stats(one_step(spark, folder), SEG)


NORMAL_CTE = f""",
wa AS (SELECT segment, model, e AS y, row_number() OVER (PARTITION BY segment, model ORDER BY e, j) AS k, CAST(m AS DOUBLE) AS n FROM p),
wb AS (SELECT *, (k - 0.375) / (n + 0.25) AS p, (n - 0.375) / (n + 0.25) AS p1, (n - 1.375) / (n + 0.25) AS p2 FROM wa),
wc AS (SELECT *, {ppf('p')} AS m, {ppf('p1')} AS m1, {ppf('p2')} AS m2, 1 / sqrt(n) AS u FROM wb),
wd AS (SELECT *, SUM(m * m) OVER (PARTITION BY segment, model) AS mm FROM wc),
we AS (SELECT *, m1 / sqrt(mm) + {poly('u', describe.SW_LAST[::-1])} AS a1, m2 / sqrt(mm) + {poly('u', describe.SW_SECOND[::-1])} AS a2 FROM wd),
wf AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM we),
wh AS (SELECT *, CASE WHEN k = 1 THEN -a1 WHEN k = 2 THEN -a2 WHEN k = n THEN a1 WHEN k = n - 1 THEN a2 ELSE m / sqrt(phi) END AS w FROM wf),
ws AS (SELECT segment, model, MAX(n) AS n, pow(SUM(w * y), 2) / (VAR_POP(y) * COUNT(*)) AS w FROM wh GROUP BY 1, 2),
wz AS (SELECT *, (ln(1 - w) - {poly('ln(n)', describe.SW_LARGE_MEAN[::-1])}) / exp({poly('ln(n)', describe.SW_LARGE_STD[::-1])}) AS z FROM ws),
wq AS (SELECT *, 1 - {cdf('z')} AS shapiro_p FROM wz),
jm AS (SELECT segment, model, AVG(e) AS mu FROM p GROUP BY 1, 2),
jn AS (SELECT segment, model, COUNT(*) AS c, AVG(pow(e - mu, 2)) AS m2, AVG(pow(e - mu, 3)) AS m3, AVG(pow(e - mu, 4)) AS m4
       FROM p JOIN jm USING (segment, model) GROUP BY 1, 2),
jk AS (SELECT segment, model, c, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM jn),
jb AS (SELECT *, c / 6e0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jb FROM jk),
nm AS (SELECT *, exp(-jb / 2) AS jb_p FROM wq JOIN jb USING (segment, model))
"""


@query(
    "residual_normality",
    f"""{G}{ONE}{NORMAL_CTE} SELECT segment, model, {rs('w', 'shapiro_p', 'jb', 'jb_p', 'skewness', 'kurtosis')},
        CASE WHEN shapiro_p > 0.05 AND ABS(skewness) < 1 AND ABS(kurtosis) < 3 THEN 'Residuals appear normally distributed'
             WHEN shapiro_p > 0.05 THEN 'Residuals pass statistical test but may not be perfectly normal'
             WHEN ABS(skewness) > 2 OR ABS(kurtosis) > 7 THEN 'Residuals show significant non-normality'
             ELSE 'Residuals may deviate from normality but acceptable for forecasting' END AS interpretation FROM nm""",
)
def residual_normality(spark, folder):
    return evaluate.residual_normality(one_step(spark, folder), SEG)


LB_CTE = """,
pd AS (SELECT segment, model, j, m, e - AVG(e) OVER (PARTITION BY segment, model) AS d FROM p),
pl AS (SELECT a.segment, a.model, MAX(a.m) AS m, a.j - b.j AS lag, SUM(a.d * b.d) AS s FROM pd a
       JOIN pd b ON b.segment = a.segment AND b.model = a.model AND b.j <= a.j AND b.j >= a.j - 12 GROUP BY 1, 2, 4),
lb AS (SELECT segment, model, MAX(m) * (MAX(m) + 2) * SUM(CASE WHEN lag > 0 THEN pow(s, 2) / (m - lag) END)
              / pow(MAX(CASE WHEN lag = 0 THEN s END), 2) AS q, MAX(m) AS m FROM pl GROUP BY 1, 2),
lp AS (SELECT *, exp(-q / 2) * (1 + q/2 + pow(q/2, 2)/2 + pow(q/2, 3)/6 + pow(q/2, 4)/24 + pow(q/2, 5)/120) AS pv FROM lb WHERE m > 12)
"""


@query(
    "ljung_box",
    f"""{G}{ONE}{LB_CTE} SELECT segment, model, {rs('lb_stat=q', 'lb_pvalue=pv')}, pv < 0.05 AS has_autocorrelation,
        CASE WHEN pv > 0.05 THEN 'Residuals are independent' ELSE 'Residuals show autocorrelation - model may be misspecified' END AS interpretation
        FROM lp""",
)
def ljung_box(spark, folder):
    return evaluate.ljung_box(one_step(spark, folder), SEG).where(F.col("lb_stat").isNotNull())


# the Student tail is a finite series: every term multiplies the one before
HETERO_CTE = """,
hq AS (SELECT segment, model, j, m, e * e AS e2 FROM p WHERE m >= 10),
hk AS (SELECT *, rank() OVER (PARTITION BY segment, model ORDER BY e2)
              + (COUNT(*) OVER (PARTITION BY segment, model, e2) - 1) / 2e0 AS rk FROM hq),
hc AS (SELECT segment, model, corr(j, e2) AS correlation, corr(j, rk) AS rho, COUNT(*) - 2 AS dof FROM hk GROUP BY 1, 2),
ht AS (SELECT *, atan(ABS(rho * sqrt(dof / ((1 - rho) * (1 + rho)))) / sqrt(dof)) AS th, dof % 2 AS odd FROM hc),
hx AS (SELECT segment, model, th, odd, unnest(range(0, CAST(floor((dof - 2 - odd) / 2e0) AS BIGINT))) AS i FROM ht),
hy AS (SELECT *, SUM(ln(pow(cos(th), 2) * (1 + odd + 2 * i) / (2e0 + odd + 2 * i))) OVER (PARTITION BY segment, model ORDER BY i) AS lt FROM hx),
hz AS (SELECT segment, model, 1 + SUM(exp(lt)) AS total FROM hy GROUP BY 1, 2),
hp AS (SELECT ht.*, GREATEST(1 - CASE WHEN odd = 1 THEN (th + sin(th) * cos(th) * COALESCE(total, 1)) * 2 / pi()
                                      ELSE sin(th) * COALESCE(total, 1) END, 0) AS pv
       FROM ht LEFT JOIN hz USING (segment, model))
"""


@query(
    "heteroscedasticity",
    f"""{G}{ONE}{HETERO_CTE} SELECT segment, model, {rs('correlation', 'rho', 'rho_p_value=pv')}, ABS(correlation) > 0.3 AS is_heteroscedastic,
        pv < 0.05 AS spearman_heteroscedastic,
        CASE WHEN ABS(correlation) < 0.3 THEN 'Constant variance' ELSE 'Variance changes over time' END AS interpretation FROM hp""",
)
def heteroscedasticity(spark, folder):
    return evaluate.heteroscedasticity(one_step(spark, folder), SEG)


@query(
    "heteroscedasticity_statistics",
    f"""{G}{ONE}, q AS (SELECT segment, model, j, m, e * e AS e2 FROM p WHERE m >= 10),
        k AS (SELECT *, rank() OVER (PARTITION BY segment, model ORDER BY e2)
                        + (COUNT(*) OVER (PARTITION BY segment, model, e2) - 1) / 2e0 AS rk FROM q)
        SELECT segment, model, {rs('correlation=corr(j, e2)', 'rho=corr(j, rk)')}, ABS(corr(j, e2)) > 0.3 AS is_heteroscedastic
        FROM k GROUP BY 1, 2""",
)
def heteroscedasticity_statistics(spark, folder):
    out = evaluate.heteroscedasticity(one_step(spark, folder), SEG)
    return out.select("segment", "model", "correlation", "rho", "is_heteroscedastic")


RUNS_CTE = """,
ru AS (SELECT *, CAST(e > MEDIAN(e) OVER (PARTITION BY segment, model) AS INT) AS up FROM p),
rt AS (SELECT *, COALESCE(CAST(up <> LAG(up) OVER (PARTITION BY segment, model ORDER BY j) AS INT), 1) AS turn FROM ru),
rn AS (SELECT segment, model, CAST(SUM(turn) AS BIGINT) AS runs, CAST(SUM(up) AS DOUBLE) AS a, CAST(SUM(1 - up) AS DOUBLE) AS b FROM rt GROUP BY 1, 2),
rv AS (SELECT *, 2 * a * b / (a + b) + 1 AS ex, 2 * a * b * (2 * a * b - a - b) / (pow(a + b, 2) * (a + b - 1)) AS v FROM rn WHERE a + b >= 10),
rz AS (SELECT *, ABS(CASE WHEN v > 0 THEN (runs - ex) / sqrt(v) ELSE 0 END) AS az, CASE WHEN v > 0 THEN (runs - ex) / sqrt(v) ELSE 0 END AS z FROM rv),
rp AS (SELECT *, CASE WHEN v > 0 THEN 2 * (1 - (""" + cdf("az") + """)) ELSE 1 END AS pv FROM rz)
"""


@query(
    "runs_test",
    f"""{G}{ONE}{RUNS_CTE} SELECT segment, model, runs, {rs('expected_runs=ex', 'z_statistic=z', 'p_value=pv')}, pv > 0.05 AS is_random,
        CASE WHEN pv > 0.05 THEN 'Residuals appear random' ELSE 'Residuals show patterns' END AS interpretation FROM rp""",
)
def runs_test(spark, folder):
    return evaluate.runs_test(one_step(spark, folder), SEG)


REPORT_CTE = NORMAL_CTE + LB_CTE + HETERO_CTE + RUNS_CTE


@query(
    "residual_report",
    f"""{G}{ONE}{REPORT_CTE}, sm AS (SELECT segment, model, AVG(e) AS mean, STDDEV_POP(e) AS std, MIN(e) AS min, MAX(e) AS max, MEDIAN(e) AS median
                                    FROM p GROUP BY 1, 2)
        SELECT sm.segment, sm.model, {rs('mean', 'std', 'min', 'max', 'median', 'shapiro_p', 'jb_p', 'skewness', 'kurtosis', 'lb_stat=lp.q',
        'lb_pvalue=lp.pv', 'correlation', 'rho', 'runs_p=rp.pv')}, lp.pv < 0.05 AS has_autocorrelation, ABS(correlation) > 0.3 AS is_heteroscedastic,
        rp.runs, rp.pv > 0.05 AS is_random
        FROM sm LEFT JOIN nm USING (segment, model) LEFT JOIN lp USING (segment, model) LEFT JOIN hp USING (segment, model)
        LEFT JOIN rp USING (segment, model)""",
)
def residual_report(spark, folder):
    return evaluate.residual_report(one_step(spark, folder), SEG)


@query(
    "forecast_quality_text",
    f"""{G}{ONE}{NORMAL_CTE}{LB_CTE}{metrics_cte('p', 'qm')},
        qn AS (SELECT segment, model, STDDEV_POP(e) AS noise FROM p GROUP BY 1, 2),
        qc AS (SELECT segment, model, AVG(CAST(ABS(e) <= 1.96 * noise AS DOUBLE)) * 100 AS coverage_pct FROM p JOIN qn USING (segment, model) GROUP BY 1, 2)
        SELECT segment, model, {rs('coverage_pct')}, concat_ws('. ',
            CASE WHEN r2 > 0.9 THEN 'Excellent fit (R² > 0.9)' WHEN r2 > 0.8 THEN 'Good fit (R² > 0.8)'
                 WHEN r2 > 0.6 THEN 'Moderate fit (R² > 0.6)' ELSE 'Poor fit (R² < 0.6)' END,
            CASE WHEN mape < 5 THEN 'High accuracy (MAPE < 5%)' WHEN mape < 10 THEN 'Good accuracy (MAPE < 10%)' END,
            CASE WHEN coverage_pct > 90 THEN 'Reliable confidence intervals (' || CAST(floor(coverage_pct + 0.50003141) AS BIGINT) || '% coverage)' END,
            CASE WHEN shapiro_p > 0.05 THEN 'Residuals are normally distributed' END,
            CASE WHEN NOT (pv < 0.05) THEN 'No significant autocorrelation in residuals' END) AS interpretation
        FROM qm JOIN qc USING (segment, model) LEFT JOIN nm USING (segment, model) LEFT JOIN lp USING (segment, model)""",
)
def forecast_quality_text(spark, folder):
    return evaluate.forecast_quality_text(one_step(spark, folder), SEG)


# -- intervals ---------------------------------------------------------------

NOISE_CTE = ", ns AS (SELECT segment, model, STDDEV_POP(e) AS noise FROM p GROUP BY 1, 2)"


def banded_sql(margin: str, source: str = "fc") -> str:
    return f"segment, model, step, date, {rs('yhat', f'lower=yhat - {margin}', f'upper=yhat + {margin}')} FROM {source}"


@query("interval_residual", f"{GREC}{FC}{ONE}{NOISE_CTE} SELECT {banded_sql('1.96 * noise')} JOIN ns USING (segment, model)")
def interval_residual(spark, folder):
    return ensemble.interval_residual(averages(series(spark, folder)), one_step(spark, folder), SEG)


@query(
    "interval_percent_error",
    f"{GREC}{FC}{BM} SELECT {banded_sql('yhat * 1.96 * std_error / 100')} JOIN bm USING (segment, model)",
)
def interval_percent_error(spark, folder):
    return ensemble.interval_percent_error(averages(series(spark, folder)), backtest_metrics(spark, folder), SEG)


@query("interval_fixed_pct", f"{GREC}{FC} SELECT {banded_sql('yhat * 0.1')}")
def interval_fixed_pct(spark, folder):
    return ensemble.interval_fixed_pct(averages(series(spark, folder)))


@query(
    "interval_pred_spread",
    f"{GREC}{FC} SELECT {banded_sql('1.96 * 0.1 * STDDEV_POP(yhat) OVER (PARTITION BY segment, model)')}",
)
def interval_pred_spread(spark, folder):
    return ensemble.interval_pred_spread(averages(series(spark, folder)), SEG)


@query(
    "interval_coverage",
    f"""{GREC}{BT}{ONE}{NOISE_CTE} SELECT segment, model,
        {r('AVG(CAST(y BETWEEN yhat - 1.96 * noise AND yhat + 1.96 * noise AS DOUBLE)) * 100', 'coverage_pct')}
        FROM bt JOIN ns USING (segment, model) GROUP BY 1, 2""",
)
def interval_coverage(spark, folder):
    banded = ensemble.interval_residual(backtest(spark, folder), one_step(spark, folder), SEG)
    return evaluate.interval_coverage(banded, SEG)


# -- ensembles ---------------------------------------------------------------

WEIGHT_CTE = ", wt AS (SELECT segment, model, (1 / rmse) / SUM(1 / rmse) OVER (PARTITION BY segment) AS weight FROM bm)"
ENS_CTE = WEIGHT_CTE + """,
en AS (SELECT segment, date, SUM(yhat * weight) / SUM(weight) AS yhat, COUNT(*) AS models_used, AVG(yhat) AS plain,
              STDDEV_POP(yhat) AS spread FROM fc JOIN wt USING (segment, model) GROUP BY 1, 2)
"""


@query("ensemble_weights", f"{GREC}{BM}{WEIGHT_CTE} SELECT segment, model, {rs('weight')} FROM wt")
def ensemble_weights(spark, folder):
    return ensemble.inverse_rmse_weights(backtest_metrics(spark, folder), SEG)


@query("ensemble_inverse_rmse", f"{GREC}{FC}{BM}{ENS_CTE} SELECT segment, date, {rs('yhat')}, models_used, 'ensemble' AS model FROM en")
def ensemble_inverse_rmse(spark, folder):
    return ensemble.ensemble_inverse_rmse(averages(series(spark, folder)), backtest_metrics(spark, folder), SEG)


@query("ensemble_equal", f"{GREC}{FC} SELECT segment, date, {rs('yhat=AVG(yhat)')}, COUNT(*) AS models_used, 'ensemble_equal' AS model FROM fc GROUP BY 1, 2")
def ensemble_equal(spark, folder):
    return ensemble.ensemble_equal(averages(series(spark, folder)), SEG)


@query(
    "ensemble_interval",
    f"{GREC}{FC}{BM}{ENS_CTE} SELECT segment, date, {rs('spread', 'yhat', 'lower=yhat - 1.96 * spread', 'upper=yhat + 1.96 * spread')} FROM en",
)
def ensemble_interval(spark, folder):
    return ensemble.ensemble_interval(averages(series(spark, folder)), SEG, backtest_metrics(spark, folder))


@query(
    "ensemble_interval_plain",
    f"{GREC}{FC}{BM}{ENS_CTE} SELECT segment, date, {rs('spread', 'yhat=plain', 'lower=plain - 1.96 * spread', 'upper=plain + 1.96 * spread')} FROM en",
)
def ensemble_interval_plain(spark, folder):
    return ensemble.ensemble_interval(averages(series(spark, folder)), SEG)


@query(
    "ensemble_confidence",
    f"{GREC}{BM} SELECT segment, {r('GREATEST(LEAST(100 - 2 * AVG(rmse), 100), 0)', 'confidence_score')}, COUNT(*) AS models FROM bm GROUP BY 1",
)
def ensemble_confidence(spark, folder):
    return ensemble.ensemble_confidence(backtest_metrics(spark, folder), SEG)


@query(
    "fallback_forecast",
    f"""{GREC}{FC}, own AS (SELECT * FROM fc WHERE model = 'ma_12' AND step <= 6), oth AS (SELECT * FROM fc WHERE model = 'ma_3')
        SELECT oth.segment, oth.date, {r('COALESCE(own.yhat, oth.yhat * 1.05)', 'yhat')}, own.yhat IS NULL AS fallback,
               {r('CASE WHEN own.yhat IS NULL THEN oth.yhat * 1.05 * 0.9 END', 'lower')}, {r('CASE WHEN own.yhat IS NULL THEN oth.yhat * 1.05 * 1.1 END', 'upper')}
        FROM oth LEFT JOIN own ON own.segment = oth.segment AND own.date = oth.date""",
)
def fallback_forecast(spark, folder):
    ahead = averages(series(spark, folder))
    wanted = ahead.where((F.col("model") == "ma_12") & (F.col("step") <= 6))
    return ensemble.fallback_forecast(wanted, ahead.where(F.col("model") == "ma_3"), SEG)


# -- validation and ranking --------------------------------------------------

RANK_CTE = ", rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rmse, model) AS rank FROM bm)"


@query("rank_models", f"{GREC}{BM}{RANK_CTE} SELECT segment, model, {rs(*FIVE)}, n, rank, rank = 1 AS is_best FROM rk")
def rank_models(spark, folder):
    return evaluate.rank_models(backtest_metrics(spark, folder), SEG)


@query(
    "forecast_model_choice",
    f"""{GREC}{BM}{RANK_CTE} SELECT segment, model AS best_model, CASE WHEN model = 'ma_12' THEN 'sarima' ELSE model END AS forecast_model
        FROM rk WHERE rank = 1""",
)
def forecast_model_choice(spark, folder):
    ranked = evaluate.rank_models(backtest_metrics(spark, folder), SEG)
    return ensemble.forecast_model_choice(ranked, SEG, pooled=("ma_12",))


@query(
    "forecast_all_averages",
    f"""{GREC}{FC}{BM}{RANK_CTE} SELECT segment, model, step, date, {rs('yhat', *FIVE)}, n,
        FIRST_VALUE(model) OVER (PARTITION BY segment ORDER BY rank) AS best_model FROM fc JOIN rk USING (segment, model)""",
)
def forecast_all_averages(spark, folder):
    return ensemble.forecast_all_models(averages(series(spark, folder)), backtest_metrics(spark, folder), SEG)


@query("forecast_all_models")
def forecast_all_models(spark, folder):
    """Twelve steps by each of the seven models, with its errors on the newest rows and the best model of the segment."""
    df = cut_lineage(series(spark, folder).select("segment", "date", "y"))
    errors = evaluate.regression_metrics(model_set.backtest_predictions(df, SEG, TEST), SEG)
    return ensemble.forecast_all_models(model_set.forecasts(df, SEG, 12), errors, SEG)


SUMMARY_CTE = """,
cs AS (SELECT segment, arg_min(model, rmse) AS best_model, MIN(rmse) AS best_rmse, arg_max(model, rmse) AS worst_model, MAX(rmse) AS worst_rmse
       FROM bm GROUP BY 1)
"""


@query(
    "comparison_summary",
    f"""{GREC}{BM}{SUMMARY_CTE} SELECT segment, best_model, worst_model, {rs('best_rmse', 'worst_rmse',
        'improvement_over_worst=COALESCE((worst_rmse - best_rmse) / NULLIF(worst_rmse, 0) * 100, 0)')} FROM cs""",
)
def comparison_summary(spark, folder):
    return evaluate.comparison_summary(backtest_metrics(spark, folder), SEG)


@query("accuracy_gauge", f"{GREC}{BM} SELECT segment, {r('GREATEST(20, 100 - 5 * MIN(rmse))', 'accuracy')} FROM bm GROUP BY 1")
def accuracy_gauge(spark, folder):
    return evaluate.accuracy_gauge(backtest_metrics(spark, folder), SEG)


@query(
    "compare_models_wide",
    f"""{GREC}{BM} SELECT segment, {rs(*[f"ma_{w}_{c}=MAX({c}) FILTER (model = 'ma_{w}')" for w in WINDOWS for c in ('rmse', 'mae', 'mape')])}
        FROM bm GROUP BY 1""",
)
def compare_models_wide(spark, folder):
    return evaluate.compare_models_wide(backtest_metrics(spark, folder), SEG, [f"ma_{w}" for w in WINDOWS])


FOLD_CTE = """,
fo AS (SELECT g.*, f.fold, len - 12 * (6 - f.fold) AS fend FROM g CROSS JOIN range(1, 6) f(fold)),
fr AS (SELECT *, CASE WHEN i < fend THEN 'train' ELSE 'test' END AS part FROM fo WHERE fend >= 24 AND i < fend + 12)
"""


@query("walk_forward_folds", f"{G}{FOLD_CTE} SELECT segment, date, {rs('y')}, fold, part FROM fr")
def walk_forward_folds(spark, folder):
    return evaluate.walk_forward_folds(series(spark, folder), SEG)


CV_CTE = FOLD_CTE + """,
cp AS (SELECT segment, fold, list(y ORDER BY i) AS ys, MAX(date) AS last FROM fr WHERE part = 'train' GROUP BY 1, 2),
cr AS (SELECT segment, fold, last, 0 AS step, ys[-3:] AS tail, CAST(NULL AS DOUBLE) AS yhat FROM cp
       UNION ALL SELECT segment, fold, last, step + 1, list_append(tail[2:], list_sum(tail) / 3), list_sum(tail) / 3 FROM cr WHERE step < 12),
ct AS (SELECT cr.segment, cr.fold, 'moving_average' AS model, fr.y, cr.yhat FROM cr
       JOIN fr ON fr.segment = cr.segment AND fr.fold = cr.fold AND fr.part = 'test' AND fr.date = CAST(cr.last + to_months(cr.step) AS DATE))
"""


@query(
    "walk_forward_cv_average",
    f"""{GREC}{CV_CTE}{metrics_cte('ct', 'cm', 'segment, model, fold')} SELECT segment, model,
        {rs('mean_rmse=AVG(rmse)', 'mean_mae=AVG(mae)', 'mean_mape=AVG(mape)', 'std_rmse=STDDEV_POP(rmse)')}, COUNT(*) AS n_splits FROM cm GROUP BY 1, 2""",
)
def walk_forward_cv_average(spark, folder):
    return evaluate.walk_forward_cv(series(spark, folder), SEG, models=("moving_average",))


@query("walk_forward_cv")
def walk_forward_cv(spark, folder):
    return evaluate.walk_forward_cv(series(spark, folder), SEG, models=tuple(model_set.MODELS))
