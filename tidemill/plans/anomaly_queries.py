"""Outlier rules on segment and line series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import anomaly
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs

SEG, LINE = tb.SEGMENT, tb.LINE

SEVERITY_SQL = """CASE WHEN z_score > 3.5 THEN 'critical' WHEN z_score > 3 THEN 'high'
  WHEN z_score > 2.5 THEN 'medium' WHEN z_score > 2 THEN 'low' ELSE 'normal' END"""

SCORED_SQL = f"""WITH {tb.SEGMENT_SQL},
st AS (SELECT segment, AVG(y) AS m, STDDEV_POP(y) AS s, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3,
              quantile_cont(y, 0.95) AS p95 FROM seg GROUP BY 1),
sc0 AS (SELECT seg.*, m, p95, CASE WHEN s > 0 THEN ABS(y - m) / s ELSE 0 END AS z_score,
               q1 - 1.5 * (q3 - q1) AS iqr_lower, q3 + 1.5 * (q3 - q1) AS iqr_upper FROM seg JOIN st USING (segment)),
sc AS (SELECT *, z_score > 2.5 AS is_anomaly_zscore, {SEVERITY_SQL} AS severity,
              y < iqr_lower OR y > iqr_upper AS is_anomaly_iqr,
              z_score > 2.5 OR y < iqr_lower OR y > iqr_upper AS is_anomaly FROM sc0)
"""


def series(spark, folder):
    return tb.segment_series(spark, folder).drop("n")


@query("zscore_pop", f"{SCORED_SQL} SELECT segment, date, {rs('y', 'z_score')}, is_anomaly_zscore, severity FROM sc")
def zscore_pop(spark, folder):
    return anomaly.zscore_pop(series(spark, folder), SEG)


@query(
    "zscore_sample_signed",
    f"""WITH {tb.LINE_SQL},
        z AS (SELECT returnflag, linestatus, date, y, quantity,
                     (y - AVG(y) OVER k) / NULLIF(STDDEV_SAMP(y) OVER k, 0) AS y_zscore,
                     (quantity - AVG(quantity) OVER k) / NULLIF(STDDEV_SAMP(quantity) OVER k, 0) AS quantity_zscore
              FROM line WINDOW k AS (PARTITION BY returnflag, linestatus))
        SELECT returnflag, linestatus, date, {rs('y', 'quantity', 'y_zscore', 'quantity_zscore')},
               COALESCE(ABS(y_zscore) > 2, FALSE) AS is_anomaly_zscore,
               CASE WHEN ABS(y_zscore) > 2.5 THEN 'high' WHEN ABS(y_zscore) > 2 THEN 'medium' ELSE 'low' END AS severity
        FROM z""",
)
def zscore_sample_signed(spark, folder):
    return anomaly.zscore_sample_signed(tb.line_series(spark, folder).drop("n"), LINE, ["y", "quantity"])


@query("severity_ladder", f"{SCORED_SQL} SELECT severity, COUNT(*) AS n FROM sc GROUP BY 1")
def severity_ladder(spark, folder):
    return anomaly.zscore_pop(series(spark, folder), SEG).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("iqr_bounds", f"{SCORED_SQL} SELECT segment, date, {rs('y', 'iqr_lower', 'iqr_upper')}, is_anomaly_iqr FROM sc")
def iqr_bounds(spark, folder):
    return anomaly.iqr_bounds(series(spark, folder), SEG)


@query(
    "anomaly_combined",
    f"""{SCORED_SQL} SELECT segment, date, {rs('y', 'z_score', 'iqr_lower', 'iqr_upper')},
        is_anomaly_zscore, severity, is_anomaly_iqr, is_anomaly FROM sc""",
)
def anomaly_combined(spark, folder):
    return anomaly.anomaly_combined(series(spark, folder), SEG)


@query(
    "anomaly_summary",
    f"""{SCORED_SQL} SELECT segment, COUNT(*) FILTER (is_anomaly_zscore) AS zscore_anomalies,
        COUNT(*) FILTER (is_anomaly_iqr) AS iqr_anomalies, COUNT(*) FILTER (is_anomaly) AS total_anomalies,
        {r('AVG(CAST(is_anomaly AS DOUBLE)) * 100', 'anomaly_rate')},
        CAST(2.5 AS DOUBLE) AS zscore_threshold, CAST(1.5 AS DOUBLE) AS iqr_multiplier,
        COUNT(*) FILTER (is_anomaly AND severity = 'low') AS low,
        COUNT(*) FILTER (is_anomaly AND severity = 'medium') AS medium,
        COUNT(*) FILTER (is_anomaly AND severity = 'high') AS high,
        COUNT(*) FILTER (is_anomaly AND severity = 'critical') AS critical FROM sc GROUP BY 1""",
)
def anomaly_summary(spark, folder):
    return anomaly.anomaly_summary(anomaly.anomaly_combined(series(spark, folder), SEG), SEG)


@query(
    "anomaly_cause",
    f"""{SCORED_SQL} SELECT segment, date, {rs('y', 'z_score')}, severity,
        CASE WHEN month(date) IN (10, 11, 12) THEN 'Festive season spike'
             WHEN month(date) IN (4, 5, 6) THEN 'Post-COVID adoption surge'
             WHEN z_score > 3 THEN 'Exceptional volume' ELSE 'Unusual pattern' END AS possible_cause
        FROM sc WHERE is_anomaly""",
)
def anomaly_cause(spark, folder):
    scored = anomaly.anomaly_combined(series(spark, folder), SEG)
    named = anomaly.anomaly_cause(scored, SEG).where("is_anomaly")
    return named.select("segment", "date", "y", "z_score", "severity", "possible_cause")


@query(
    "anomaly_cause_level",
    f"""{SCORED_SQL} SELECT segment, date, {rs('y', 'z_score')}, severity,
        CASE WHEN month(date) IN (10, 11, 12) AND y > m THEN 'Festive season spike'
             WHEN month(date) IN (4, 5, 6) AND y > m THEN 'Post-COVID adoption surge'
             WHEN y < m * 0.5 THEN 'Potential system outage or data issue'
             WHEN y > p95 THEN 'Exceptional transaction volume' ELSE 'Unusual pattern detected' END AS possible_cause
        FROM sc WHERE is_anomaly""",
)
def anomaly_cause_level(spark, folder):
    scored = anomaly.anomaly_combined(series(spark, folder), SEG)
    named = anomaly.anomaly_cause(scored, SEG, "level").where("is_anomaly")
    return named.select("segment", "date", "y", "z_score", "severity", "possible_cause")
