"""Pooled models, importance tables, insights and KPIs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import evaluate, explain, insights, ml, model_set, parts
from tidemill.operators import features as ft
from tidemill.plans import feature_queries as fq
from tidemill.plans import model_queries as mq
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs
from tidemill.session import cut_lineage, scratch_folder
from tidemill.sources import models

SEG = tb.SEGMENT
series = mq.series


# -- pooled models -----------------------------------------------------------


def trained(spark, folder):
    """Rows of all segments, split by time; written once for the passes of a fit."""
    rows = cut_lineage(ml.model_rows(series(spark, folder), SEG))
    return (rows, *ml.split_rows(rows, mq.TEST))


@query("fit_ridge")
def fit_ridge(spark, folder):
    _, train, test = trained(spark, folder)
    return ml.predict(ml.fit_ridge(train), test, SEG, "ridge")


@query("linear_coefficients")
def linear_coefficients(spark, folder):
    _, train, _ = trained(spark, folder)
    return ml.linear_coefficients(ml.fit_ridge(train), spark)


@query("fit_gbt")
def fit_gbt(spark, folder):
    _, train, test = trained(spark, folder)
    return ml.predict(ml.fit_gbt(train), test, SEG, "gbt")


@query("fit_random_forest")
def fit_random_forest(spark, folder):
    _, train, test = trained(spark, folder)
    return ml.predict(ml.fit_random_forest(train), test, SEG, "random_forest")


@query("tree_importance")
def tree_importance(spark, folder):
    _, train, _ = trained(spark, folder)
    return ml.tree_importance(ml.fit_random_forest(train), spark, "random_forest")


@query("forecast_recursive")
def forecast_recursive(spark, folder):
    rows, _, _ = trained(spark, folder)
    return ml.forecast_recursive(ml.fit_ridge(rows), series(spark, folder), SEG)


@query("permutation_importance")
def permutation_importance(spark, folder):
    _, train, test = trained(spark, folder)
    return ml.permutation_importance(ml.fit_ridge(train), test, SEG)


@query("model_registry")
def model_registry(spark, folder):
    rows, train, _ = trained(spark, folder)
    root = scratch_folder(spark, "models")
    bounds = train.agg(F.date_format(F.min("date"), "yyyy-MM-dd"), F.date_format(F.max("date"), "yyyy-MM-dd")).first()
    for day in (1, 2):
        models.save_model(
            ml.fit_ridge(train), root, "ridge", datetime(2026, 1, day), ml.feature_names(), tuple(bounds), {"alpha": 1.0}
        )
    models.load_model(spark, root, "ridge")
    return models.model_registry(spark, root).select(
        "model_name", "model_type", "version", "train_start", "train_end", F.size("feature_names").alias("features"), "is_active"
    )


@query("evaluate_all_models")
def evaluate_all_models(spark, folder):
    """Seven models on the last year of every segment."""
    return evaluate.evaluate_all_models(series(spark, folder), SEG, mq.TEST)


@query("failed_fits")
def failed_fits(spark, folder):
    """Series that each model of single series could not fit, over sparse customer series."""
    df = tb.customer_series(spark, folder).drop("n")
    names = tuple(model_set.SERIES_MODELS)
    return model_set.failed_fits(df, model_set.forecasts(df, tb.CUSTOMER, 3, names), tb.CUSTOMER, names)


# -- importance of fitted models ---------------------------------------------


def fitted(spark, folder) -> DataFrame:
    """(model, feature, importance) of ridge, boosted trees and forest, learnt on all but the newest rows."""
    _, train, _ = trained(spark, folder)
    return model_set.importance_of_fits(train)


@query("fitted_importance_ranked")
def fitted_importance_ranked(spark, folder):
    return explain.importance_ranked(fitted(spark, folder), ["model"])


@query("fitted_importance_by_category")
def fitted_importance_by_category(spark, folder):
    return explain.importance_by_category(fitted(spark, folder), ["model"])


@query("fitted_importance_over_models")
def fitted_importance_over_models(spark, folder):
    """Mean over the three models; here ``models`` counts models."""
    return explain.importance_over_models(fitted(spark, folder))


@query("fitted_explain_text")
def fitted_explain_text(spark, folder):
    return explain.explain_text(fitted(spark, folder), ["model"])


# -- importance --------------------------------------------------------------

# Stand-in importances that SQL can compute as well: |correlation| with the target per segment.
IMPORTANCE = (
    "lag_1", "lag_3", "lag_12", "rolling_mean_3", "rolling_mean_12", "rolling_std_6", "mom_growth_lag1",
    "yoy_growth_lag1", "trend", "month_sin", "month_cos", "quarter_cos", "is_festive", "volume_diff_lag1",
)
FEATURE_SQL = {
    **fq.LAG_SQL, **fq.ROLLING_SQL, **fq.MOM_SQL, **fq.YOY_SQL, **fq.TREND_SQL, **fq.CYCLE_SQL, **fq.EVENT_SQL, **fq.DIFF_SQL,
}
IMP = f"""{mq.G},
fe AS (SELECT segment, date, y, {', '.join(f'{FEATURE_SQL[f]} AS {f}' for f in IMPORTANCE)} FROM g QUALIFY i >= 13),
im0 AS (SELECT segment, {', '.join(f'ABS(corr(y, {f})) AS {f}' for f in IMPORTANCE)} FROM fe GROUP BY 1),
im AS (UNPIVOT im0 ON {', '.join(IMPORTANCE)} INTO NAME feature VALUE importance),
ir AS (SELECT *, row_number() OVER w AS rank, SUM(importance) OVER (w ROWS UNBOUNDED PRECEDING) AS cum,
              SUM(importance) OVER (PARTITION BY segment) AS total
       FROM im WINDOW w AS (PARTITION BY segment ORDER BY importance DESC, feature))
"""


def featured(spark, folder) -> DataFrame:
    return ft.create_features(series(spark, folder), SEG, "service", nulls="drop")


def importance(spark, folder) -> DataFrame:
    wide = featured(spark, folder).groupBy("segment").agg(*[F.abs(F.corr("y", f)).alias(f) for f in IMPORTANCE])
    return wide.unpivot(["segment"], list(IMPORTANCE), "feature", "importance").where(F.col("importance").isNotNull())


@query("importance_ranked", f"{IMP} SELECT segment, feature, {rs('importance', 'cumulative_importance=cum')}, rank FROM ir")
def importance_ranked(spark, folder):
    return explain.importance_ranked(importance(spark, folder), ["segment"])


@query(
    "importance_top_n",
    f"{IMP} SELECT segment, feature, {rs('importance', 'importance_pct=importance / total * 100', 'cumulative_pct=cum / total * 100')}, rank FROM ir WHERE rank <= 10",
)
def importance_top_n(spark, folder):
    return explain.importance_top_n(importance(spark, folder), ["segment"])


CATEGORY = """CASE WHEN starts_with(feature, 'lag_') THEN 'lag' WHEN starts_with(feature, 'rolling_') THEN 'rolling'
  WHEN contains(feature, 'growth') OR contains(feature, 'momentum') THEN 'growth'
  WHEN regexp_matches(feature, 'temporal|month|quarter|year|sin|cos') THEN 'temporal' WHEN contains(feature, 'decomp') THEN 'decomposition'
  WHEN contains(feature, 'fourier') THEN 'fourier' WHEN regexp_matches(feature, 'is_|festive|lockdown') THEN 'event' ELSE 'other' END"""


@query(
    "importance_by_category",
    f"{IMP} SELECT segment, {CATEGORY} AS category, {r(r('SUM(importance)', digits=4), 'importance')}, COUNT(*) AS features FROM im GROUP BY 1, 2",
)
def importance_by_category(spark, folder):
    return explain.importance_by_category(importance(spark, folder), ["segment"])


@query(
    "importance_over_models",
    f"{IMP} SELECT feature, {rs('importance=AVG(importance)')}, COUNT(*) AS models FROM im GROUP BY 1 ORDER BY AVG(importance) DESC, feature LIMIT 10",
)
def importance_over_models(spark, folder):
    return explain.importance_over_models(importance(spark, folder))


def named_sql(pattern: str, n: int) -> str:
    return f"array_to_string(list_slice(list_filter(f, lambda v: regexp_matches(v, '{pattern}')), 1, {n}), ', ')"


@query(
    "explain_text",
    f"""{IMP}, tf AS (SELECT segment, list(feature ORDER BY rank) AS f FROM ir WHERE rank <= 5 GROUP BY 1),
        tx AS (SELECT segment, f,
          CASE WHEN {named_sql('lag', 3)} <> '' THEN 'Past values significantly influence predictions. Key lags: ' || {named_sql('lag', 3)} END AS lag_importance,
          CASE WHEN {named_sql('rolling', 2)} <> '' THEN 'Moving averages are important for predictions. Key windows: ' || {named_sql('rolling', 2)} END AS rolling_importance,
          CASE WHEN {named_sql('growth', 2)} <> '' THEN 'Growth rates are predictive of future values. Features: ' || {named_sql('growth', 2)} END AS growth_importance,
          CASE WHEN {named_sql('month|sin|cos', 1)} <> '' THEN 'Seasonality plays a role in predictions. Calendar features help capture periodic patterns.' END AS temporal_importance
          FROM tf)
        SELECT segment, lag_importance, rolling_importance, growth_importance, temporal_importance,
               CASE WHEN COALESCE(lag_importance, rolling_importance, growth_importance, temporal_importance) IS NULL
                    THEN 'Multiple features contribute to predictions. Top feature: ' || f[1] END AS general FROM tx""",
)
def explain_text(spark, folder):
    return explain.explain_text(importance(spark, folder), ["segment"])


@query(
    "prediction_factors",
    f"""{IMP}, lv AS (UNPIVOT (SELECT segment, date, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in IMPORTANCE)} FROM fe)
             ON {', '.join(IMPORTANCE)} INTO NAME feature VALUE value)
        SELECT segment, date, 'Key factors: ' || array_to_string(list(printf('%s=%.2f (importance: %.4f)', feature,
               {r('value', digits=2)}, {r('importance', digits=4)}) ORDER BY rank), '; ') AS explanation
        FROM lv JOIN ir USING (segment, feature) WHERE rank <= 5 GROUP BY 1, 2""",
)
def prediction_factors(spark, folder):
    wide = featured(spark, folder).select("segment", "date", *[F.col(f).cast("double").alias(f) for f in IMPORTANCE])
    values = wide.unpivot(["segment", "date"], list(IMPORTANCE), "feature", "value")
    return explain.prediction_factors(values, importance(spark, folder), ["segment"], ["segment", "date"])


@query(
    "interpretability_report",
    f"""{IMP}, ca AS (SELECT segment, {CATEGORY} AS category, {r('SUM(importance)', 'v', 4)} FROM im GROUP BY 1, 2),
        ma AS (SELECT segment, MAX(v) FILTER (category = 'lag') AS l, MAX(v) FILTER (category = 'rolling') AS ro,
                      MAX(v) FILTER (category = 'temporal') AS t FROM ca GROUP BY 1)
        SELECT segment, CAST(10 AS BIGINT) AS top, printf('The most important feature is ''%s'' with %.1f%% relative importance.', feature,
               {r('importance / total * 100', digits=1)}) || COALESCE(CASE WHEN l > 0 THEN printf(' Lag features contribute %.4f to the model.', l) END, '')
               || COALESCE(CASE WHEN ro > 0 THEN printf(' Rolling statistics contribute %.4f.', ro) END, '')
               || COALESCE(CASE WHEN t > 0 THEN printf(' Seasonal/temporal patterns contribute %.4f.', t) END, '') AS summary
        FROM ir JOIN ma USING (segment) WHERE rank = 1""",
)
def interpretability_report(spark, folder):
    report = explain.interpretability_report(importance(spark, folder), ["segment"])
    return report.select("segment", F.size("top_features").alias("top"), "summary")


# -- insights ----------------------------------------------------------------

FACTS = """,
fi AS (SELECT *, len - i AS age, (y - LAG(y, 12) OVER w) / NULLIF(LAG(y, 12) OVER w, 0) * 100 AS yoy,
              y / NULLIF(LAG(y) OVER w, 0) - 1 AS mm, y - LAG(y) OVER w AS d FROM g WINDOW w AS (PARTITION BY segment ORDER BY date)),
fa AS (SELECT segment, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date, MAX(y) FILTER (i = 0) AS first,
       MAX(y) FILTER (age = 1) AS latest, MAX(y) FILTER (age = 13) AS year_ago, AVG(y) AS mean, MAX(y) AS maxy,
       COALESCE(MAX(mm) FILTER (age = 1) * 100, 0) AS mom, MAX(yoy) FILTER (age = 1) AS yoy, AVG(yoy) AS avg_yoy,
       AVG(y) FILTER (age <= 6) AS rh, AVG(y) FILTER (age > 6 AND age <= 12) AS eh, AVG(d) FILTER (age <= 6) AS rstep,
       STDDEV_SAMP(mm) FILTER (age <= 6) AS vol, AVG(y) FILTER (month(date) IN (10, 11, 12)) AS fm, AVG(y) FILTER (month(date) <= 3) AS q1m,
       (pow(MAX(y) FILTER (age = 1) / NULLIF(MAX(y) FILTER (i = 0), 0), 12e0 / COUNT(*)) - 1) * 100 AS cagr FROM fi GROUP BY 1),
mo AS (SELECT segment, month(date) AS m, AVG(y) AS v FROM g GROUP BY 1, 2),
mx AS (SELECT segment, arg_max(m, v) AS hm, MAX(v) AS hv, arg_min(m, v) AS lm, MIN(v) AS lo, AVG(v) AS mv FROM mo GROUP BY 1)
"""
BEST = """,
be AS (SELECT segment, arg_min(model, rmse) AS best_model, MIN(rmse) AS best_rmse, arg_max(model, rmse) AS worst_model, MAX(rmse) AS worst_rmse FROM bm GROUP BY 1),
nx AS (SELECT segment, AVG(yhat) AS next_mean, STDDEV_POP(yhat) AS next_std, COUNT(*) AS models FROM fc WHERE step = 1 GROUP BY 1),
bn AS (SELECT be.*, fc.yhat AS nextv FROM be LEFT JOIN fc ON fc.segment = be.segment AND fc.model = be.best_model AND fc.step = 1)
"""
ALL = f"{mq.GREC}{FACTS}{mq.FC}{mq.BM}{BEST}"
GF = f"{mq.G}{FACTS}"


def f0(x: str) -> str:
    return r(x, digits=0)


def text_sql(template: str, *values: str) -> str:
    """The template filled in by printf."""
    quoted = template.replace("'", "''")
    return f"printf({', '.join([f"'{quoted}'", *values])})"


def said(name: str, *values: str) -> str:
    return text_sql(insights.TEXTS[name], *values)


def rules_sql(source: str, rules: list[tuple[str, str]]) -> str:
    """UNION ALL of the rules whose text is not null."""
    parts = [
        f"SELECT segment, CAST({k} AS BIGINT) AS place, '{name}' AS rule, {text} AS text FROM {source}"
        for k, (name, text) in enumerate(rules, 1)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE text IS NOT NULL"


@query(
    "insight_summary",
    f"""{GF} SELECT segment, {said('summary', r('first', digits=2), r('latest', digits=2), f0('(latest - first) / first * 100'), 'n', f0('cagr'), r('mom', digits=1))}
        AS summary FROM fa""",
)
def insight_summary(spark, folder):
    return insights.insight_summary(series(spark, folder), SEG)


ACCEL = "(rh - eh) / NULLIF(eh, 0) * 100"
PACE = f"CASE WHEN {ACCEL} > 25 THEN 'much faster' WHEN {ACCEL} > 10 THEN 'faster' WHEN {ACCEL} < -5 THEN 'slower' ELSE '' END"
PHASE = f"CASE {' '.join(f"WHEN avg_yoy > {limit} THEN '{word}'" for limit, word in insights.PHASES)} ELSE '{insights.SLOW}' END"


@query(
    "insight_trends",
    f"""{GF} {rules_sql('fa', [
        ('phase', f"CASE WHEN avg_yoy IS NOT NULL THEN {said('phase', f0('avg_yoy'), PHASE)} END"),
        ('acceleration', f"CASE WHEN {PACE} <> '' THEN {said('pace', f0(ACCEL), PACE)} END"),
        ('peak', f"CASE WHEN latest > maxy * 0.95 THEN {said('near_peak')} END")])}""",
)
def insight_trends(spark, folder):
    return insights.insight_trends(series(spark, folder), SEG)


@query(
    "insight_seasonality",
    f"""{GF}, fs AS (SELECT fa.*, hm, hv / mean AS hf, lm, lo / mean AS lf, fm / mean AS ff, strftime(make_date(2000, hm, 1), '%B') AS hn,
               strftime(make_date(2000, lm, 1), '%B') AS ln FROM fa JOIN mx USING (segment))
        {rules_sql('fs', [
            ('peak', f"CASE WHEN hf > 1.15 THEN {said('high_month_far', 'hn', f0('(hf - 1) * 100'))} ELSE {said('high_month', 'hn')} END"),
            ('low', f"CASE WHEN lf < 0.85 THEN {said('low_month_far', 'ln', f0('(1 - lf) * 100'))} END"),
            ('q4', f"CASE WHEN ff > 1.1 THEN {said('last_quarter', f0('(ff - 1) * 100'))} END"),
            ('q1', f"CASE WHEN q1m < mean * 0.95 THEN {said('first_quarter')} END")])}""",
)
def insight_seasonality(spark, folder):
    return insights.insight_seasonality(series(spark, folder), SEG)


GAP = "(worst_rmse - best_rmse) / best_rmse * 100"


@query(
    "insight_models",
    f"""{ALL} {rules_sql('be', [
        ('best', said('best', 'best_model')),
        ('spread', f"CASE WHEN worst_model <> best_model THEN {said('gap', f0(GAP), f"CASE WHEN {GAP} > 50 THEN 'far apart' ELSE 'close together' END")} END")])}""",
)
def insight_models(spark, folder):
    return insights.insight_models(mq.backtest_metrics(spark, folder), SEG)


SURGE = "(fm / latest - 1) * 100"


def alert_sql(cond: str, kind: str, *values: str) -> str:
    title, text, confidence, action = insights.ALERTS[kind]
    acts = text_sql(action, *values) if "%" in action else f"'{action}'"
    return f"SELECT segment, '{kind}' AS type, '{title}' AS title, {text_sql(text, *values)} AS description, '{confidence}' AS confidence, {acts} AS action FROM al WHERE {cond}"


@query(
    "insight_alerts",
    f"{ALL}, al AS (SELECT fa.*, next_mean, next_std, models, month(CAST(last_date + INTERVAL 1 MONTH AS DATE)) AS nm FROM fa JOIN nx USING (segment)) "
    + " UNION ALL ".join([
        alert_sql("yoy > avg_yoy * 1.2", "acceleration", f0("(yoy / avg_yoy - 1) * 100")),
        alert_sql("yoy < avg_yoy * 0.8 AND NOT yoy > avg_yoy * 1.2", "deceleration", f0("yoy"), f0("avg_yoy")),
        alert_sql("models >= 2 AND next_std > latest * 0.15", "divergence", r("next_std", digits=1)),
        alert_sql("models >= 2 AND NOT next_std > latest * 0.15", "consensus", f0("next_mean")),
        alert_sql("nm IN (10, 11, 12)", "seasonal", f0(SURGE)),
        alert_sql("vol > 0.15", "volatility", r("vol * 100", digits=1)),
    ]),
)
def insight_alerts(spark, folder):
    df = series(spark, folder)
    return insights.insight_alerts(df, mq.averages(df), SEG)


@query(
    "insight_narrative",
    f"""{ALL}, ww AS (SELECT segment, arg_min(y, date) AS w0, arg_max(y, date) AS w1 FROM g WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-03-01' GROUP BY 1)
        SELECT segment, {rs('first_value=first', 'latest_value=latest', 'growth_factor=latest / first', 'window_growth_pct=(w1 - w0) / w0 * 100',
            'last_year_growth_pct=COALESCE((latest - year_ago) / year_ago * 100, 0)')}, printf('%.0fM', {f0('nextv')}) AS next_prediction,
            CASE WHEN best_rmse < 5 THEN 'high' WHEN best_rmse < 10 THEN 'medium' ELSE 'low' END AS confidence_level,
            {said('story', r('first', digits=2), r('latest', digits=2), r('latest / first', digits=1))} || {said('story_next', r('nextv', digits=2))} AS story
        FROM fa JOIN bn USING (segment) LEFT JOIN ww USING (segment)""",
)
def insight_narrative(spark, folder):
    df = series(spark, folder)
    window = ("1997-03-01", "1998-03-01")
    return insights.insight_narrative(df, mq.backtest_metrics(spark, folder), mq.averages(df), SEG, window)


@query(
    "insight_recommendations",
    f"""{GF} {rules_sql('fa', [
        ('scaling', f"CASE WHEN yoy > 50 THEN {said('growth_high')} END"),
        ('volume', f"CASE WHEN latest > mean * 2 THEN {said('level_high')} END"),
        *[(f'standing_{k}', f"'{t}'") for k, t in enumerate(insights.STANDING_ADVICE, 1)]])}""",
)
def insight_recommendations(spark, folder):
    return insights.insight_recommendations(series(spark, folder), SEG)


@query(
    "recommendations_by_priority",
    f"""{ALL}, rr AS (SELECT fa.segment, COALESCE(fa.yoy, 0) AS yoy, best_model, (nov / mean - 1) * 100 AS fb,
               AVG(d) FILTER (age <= 6) AS rd, AVG(d) FILTER (age > 6 AND age <= 12) AS ed
               FROM fa JOIN be USING (segment) JOIN fi USING (segment) JOIN (SELECT segment, v AS nov FROM mo WHERE m = 11) USING (segment) GROUP BY ALL)
        SELECT segment, 'high' AS priority, 'growth' AS category, {said('growth_high')} AS recommendation FROM rr WHERE yoy > 50
        UNION ALL SELECT segment, 'high', 'capacity', {said('november', f0('fb'))} FROM rr WHERE fb > 10
        UNION ALL SELECT segment, 'medium', 'planning', {said('steps_grow')} FROM rr WHERE rd > ed
        UNION ALL SELECT segment, 'info', 'modeling', {said('best', 'best_model')} FROM rr""",
)
def recommendations_by_priority(spark, folder):
    return insights.recommendations_by_priority(series(spark, folder), mq.backtest_metrics(spark, folder), SEG)


@query(
    "forecast_explanation",
    f"""{ALL}, ex AS (SELECT fa.*, bn.*, next_std, mo.v / mx.mv AS sf FROM fa JOIN bn ON bn.segment = fa.segment JOIN nx ON nx.segment = fa.segment
               JOIN mx ON mx.segment = fa.segment JOIN mo ON mo.segment = fa.segment AND mo.m = month(last_date))
        SELECT segment, CASE WHEN rstep > 2 THEN 'rising fast' WHEN rstep > 0 THEN 'rising' ELSE 'not rising' END AS trend,
          CASE WHEN rstep > 2 THEN 'high' WHEN rstep > 0 THEN 'moderate' ELSE 'low' END AS trend_confidence,
          CASE WHEN sf > 1.1 THEN 'above the mean of the year' WHEN sf < 0.9 THEN 'below the mean of the year' ELSE 'near the mean of the year' END AS seasonality,
          CASE WHEN best_rmse < 5 THEN 'RMSE under 5' WHEN best_rmse < 10 THEN 'RMSE under 10'
               ELSE 'RMSE of 10 or more, or none' END || CASE WHEN next_std > latest * 0.1 THEN '; models far apart' ELSE '' END AS confidence_reason,
          CASE WHEN next_std > latest * 0.1 THEN 'medium' WHEN best_rmse < 5 THEN 'low' WHEN best_rmse < 10 THEN 'medium' ELSE 'high' END AS risk_flag,
          best_model, {rs('seasonal_factor=sf', 'best_model_rmse=best_rmse', 'latest_value=latest', 'predicted_next=nextv')} FROM ex""",
)
def forecast_explanation(spark, folder):
    df = series(spark, folder)
    return insights.forecast_explanation(df, mq.backtest_metrics(spark, folder), mq.averages(df), SEG)


@query(
    "dashboard_kpis",
    f"""{ALL} SELECT segment, {rs('current_volume=latest', 'yoy_growth=COALESCE(yoy, 0)', 'mom_growth=mom', 'predicted_next_month=nextv',
          'model_confidence=GREATEST(LEAST(100 - 3 * best_rmse, 100), 0)', 'best_model_rmse=best_rmse')}, best_model,
          strftime(last_date, '%Y-%m') AS current_volume_date, strftime(first_date, '%Y-%m') AS start, n AS total_records FROM fa JOIN bn USING (segment)""",
)
def dashboard_kpis(spark, folder):
    df = parts.written(series(spark, folder), SEG)
    return insights.dashboard_kpis(df, evaluate.regression_metrics(mq.backtest_of(df), SEG), mq.averages(df), SEG)


@query("auto_insights")
def auto_insights(spark, folder):
    return insights.auto_insights(series(spark, folder), SEG)


@query("executive_findings")
def executive_findings(spark, folder):
    df = parts.written(series(spark, folder), SEG)
    metrics = evaluate.regression_metrics(mq.backtest_of(df), SEG)
    return insights.executive_findings(insights.auto_insights(df, SEG), metrics, SEG)


@query("eda_report")
def eda_report(spark, folder):
    report = insights.eda_report(series(spark, folder), SEG)
    return report.select("segment", F.to_json(F.struct(*[c for c in report.columns if c != "segment"])).alias("report"))
