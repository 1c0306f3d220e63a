"""Outlier rules. Per-key moments and quartiles are window aggregates over the same
partitioning as the series, so detection costs one exchange and no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, ladder
from tidemill.spec import SeriesSpec

# Severity steps of the two detectors, from high to low.
SEVERITY_FULL = ((3.5, "critical"), (3.0, "high"), (2.5, "medium"), (2.0, "low"))
SEVERITY_SHORT = ((2.5, "high"), (2.0, "medium"))

FESTIVE_MONTHS = (10, 11, 12)
ADOPTION_MONTHS = (4, 5, 6)


def severity_ladder(z: Column, steps: Sequence[tuple[float, str]] = SEVERITY_FULL, otherwise: str = "normal") -> Column:
    return ladder(z, steps, otherwise)


def zscore_pop(df: DataFrame, spec: SeriesSpec, threshold: float = 2.5) -> DataFrame:
    """|y - mean| / population std; zero where the series does not vary."""
    w = spec.whole()
    mean, std = F.avg(spec.value).over(w), F.stddev_pop(spec.value).over(w)
    out = df.withColumn("_m", mean).withColumn("_s", std)
    z = F.when(F.col("_s") > 0, F.abs(spec.y - F.col("_m")) / F.col("_s")).otherwise(dbl(0.0))
    out = out.withColumn("z_score", z).drop("_m", "_s")
    return out.withColumn("is_anomaly_zscore", F.col("z_score") > threshold).withColumn(
        "severity", severity_ladder(F.col("z_score"))
    )


def zscore_sample_signed(
    df: DataFrame, spec: SeriesSpec, values: Sequence[str], threshold: float = 2.0
) -> DataFrame:
    """Signed z-scores with sample std for several measures; the first decides the flag."""
    w = spec.whole()
    out = df
    for v in values:
        z = div(F.col(v) - F.avg(v).over(w), F.stddev_samp(v).over(w))
        out = out.withColumn(f"{v}_zscore", z)
    lead = F.abs(F.col(f"{values[0]}_zscore"))
    return out.withColumn("is_anomaly_zscore", F.coalesce(lead > threshold, F.lit(False))).withColumn(
        "severity", severity_ladder(lead, SEVERITY_SHORT, "low")
    )


def iqr_bounds(df: DataFrame, spec: SeriesSpec, multiplier: float = 1.5, approx: bool = False) -> DataFrame:
    """Quartile fences per key; ``approx`` trades the exact quartiles for a sketch."""
    q = F.array(dbl(0.25), dbl(0.75))
    quartiles = F.percentile_approx(spec.y, q) if approx else F.percentile(spec.y, q)
    out = df.withColumn("_q", quartiles.over(spec.whole()))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    out = (
        out.withColumn("iqr_lower", q1 - dbl(multiplier) * (q3 - q1))
        .withColumn("iqr_upper", q3 + dbl(multiplier) * (q3 - q1))
        .drop("_q")
    )
    outside = (spec.y < F.col("iqr_lower")) | (spec.y > F.col("iqr_upper"))
    return out.withColumn("is_anomaly_iqr", F.coalesce(outside, F.lit(False)))


def anomaly_combined(df: DataFrame, spec: SeriesSpec, threshold: float = 2.5, multiplier: float = 1.5) -> DataFrame:
    """z-score or quartile rule, with both scores and both bounds."""
    both = iqr_bounds(zscore_pop(df, spec, threshold), spec, multiplier)
    return both.withColumn("is_anomaly", F.col("is_anomaly_zscore") | F.col("is_anomaly_iqr"))


def anomaly_summary(scored: DataFrame, spec: SeriesSpec, threshold: float = 2.5, multiplier: float = 1.5) -> DataFrame:
    """Counts per rule and severity, rate and the thresholds used."""
    hit = F.col("is_anomaly")
    by_severity = [
        F.count_if(hit & (F.col("severity") == label)).alias(label) for label in ("low", "medium", "high", "critical")
    ]
    return scored.groupBy(*spec.keys).agg(
        F.count_if("is_anomaly_zscore").alias("zscore_anomalies"),
        F.count_if("is_anomaly_iqr").alias("iqr_anomalies"),
        F.count_if("is_anomaly").alias("total_anomalies"),
        (F.avg(hit.cast("double")) * dbl(100.0)).alias("anomaly_rate"),
        dbl(threshold).alias("zscore_threshold"),
        dbl(multiplier).alias("iqr_multiplier"),
        *by_severity,
    )


def anomaly_cause(scored: DataFrame, spec: SeriesSpec, rules: str = "calendar") -> DataFrame:
    """Cause label of a flagged row.

    ``calendar``: by month, then by z-score. ``level``: month rules need a value
    above the mean, then outage below half the mean, then above the 95th percentile.
    """
    month = F.month(spec.t)
    festive, adoption = month.isin(*FESTIVE_MONTHS), month.isin(*ADOPTION_MONTHS)
    if rules == "calendar":
        cause = (
            F.when(festive, F.lit("Festive season spike"))
            .when(adoption, F.lit("Post-COVID adoption surge"))
            .when(F.col("z_score") > 3, F.lit("Exceptional volume"))
            .otherwise(F.lit("Unusual pattern"))
        )
        return scored.withColumn("possible_cause", F.when(F.col("is_anomaly"), cause))
    if rules != "level":
        raise ValueError(f"unknown rules {rules!r}, expected 'calendar' or 'level'")
    w = spec.whole()
    out = scored.withColumn("_mean", F.avg(spec.value).over(w)).withColumn(
        "_p95", F.percentile(spec.y, dbl(0.95)).over(w)
    )
    above = spec.y > F.col("_mean")
    cause = (
        F.when(festive & above, F.lit("Festive season spike"))
        .when(adoption & above, F.lit("Post-COVID adoption surge"))
        .when(spec.y < F.col("_mean") * dbl(0.5), F.lit("Potential system outage or data issue"))
        .when(spec.y > F.col("_p95"), F.lit("Exceptional transaction volume"))
        .otherwise(F.lit("Unusual pattern detected"))
    )
    return out.withColumn("possible_cause", F.when(F.col("is_anomaly"), cause)).drop("_mean", "_p95")


def deviation_from_expected(
    actuals: DataFrame, forecasts: DataFrame, spec: SeriesSpec, alert_percent: float = 15.0
) -> DataFrame:
    """Actual against forecast: deviation percent and whether it passes the alert level."""
    expected = forecasts.select(*spec.ids, F.col("yhat").alias("expected_value"))
    joined = actuals.join(expected, spec.ids)
    deviation = div(spec.y - F.col("expected_value"), F.col("expected_value")) * dbl(100.0)
    return joined.withColumn("deviation_percent", deviation).withColumn(
        "is_alert", F.coalesce(F.abs(F.col("deviation_percent")) > alert_percent, F.lit(False))
    )
