"""Summary statistics, trend fits, seasonality and growth. One aggregate per table:
helper columns come from windows on the series keys, so the grouped aggregate that
follows reuses their partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, ladder, month_label, pct, polynomial, stable_round
from tidemill.functions.distributions import normal_cdf, normal_ppf
from tidemill.operators.parts import Part, alone, with_index
from tidemill.spec import SeriesSpec


def at_age(value: Column, k: int) -> Column:
    """Aggregate that picks the value of the k-th newest row."""
    return F.max(F.when(F.col("age") == k, value))


# -- summaries ---------------------------------------------------------------


def series_summary(df: DataFrame, spec: SeriesSpec, second: str | None = None) -> DataFrame:
    """Size, span, moments, quartiles, latest value, growth and volatility per series."""
    return alone(df, spec, SUMMARY._replace(aggs=lambda spec: _summary_aggs(spec, second)))


def _steps(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    return rows.withColumn("_diff", spec.y - F.lag(spec.value).over(spec.ordered()))


def _summary_aggs(spec: SeriesSpec, second: str | None = None) -> list[Column]:
    y, p = spec.y, spec.period
    aggs = [
        F.count(F.lit(1)).alias("total_records"),
        month_label(F.min(spec.time)).alias("start"),
        month_label(F.max(spec.time)).alias("end"),
        *_moments(y, ""),
        F.percentile(y, dbl(0.5)).alias("median"),
        F.percentile(y, dbl(0.25)).alias("q1"),
        F.percentile(y, dbl(0.75)).alias("q3"),
        F.coalesce(pct(at_age(y, 1), at_age(y, p + 1)), dbl(0.0)).alias("yoy"),
        F.coalesce(pct(at_age(y, 1), at_age(y, 2)), dbl(0.0)).alias("mom"),
        cagr_two_years(y, p).alias("cagr"),
        (div(F.stddev_samp(y), F.avg(y)) * dbl(100.0)).alias("cv"),
        F.stddev_samp("_diff").alias("diff_std"),
    ]
    if second:
        v = F.col(second)
        aggs += [
            *_moments(v, f"{second}_"),
            F.coalesce(pct(at_age(v, 1), at_age(v, p + 1)), dbl(0.0)).alias(f"{second}_yoy"),
            F.coalesce(pct(at_age(v, 1), at_age(v, 2)), dbl(0.0)).alias(f"{second}_mom"),
        ]
    return aggs


SUMMARY = Part(_summary_aggs, _steps)


def _moments(v: Column, prefix: str) -> list[Column]:
    return [
        F.avg(v).alias(f"{prefix}mean"),
        F.stddev_samp(v).alias(f"{prefix}std"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
        at_age(v, 1).alias(f"{prefix}latest"),
    ]


def yoy_mom_latest(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Growth of the newest value in percent over one season and one step; 0 without history."""
    y, p = spec.y, spec.period
    return with_index(df, spec).groupBy(*spec.keys).agg(
        F.coalesce(pct(at_age(y, 1), at_age(y, p + 1)), dbl(0.0)).alias("yoy"),
        F.coalesce(pct(at_age(y, 1), at_age(y, 2)), dbl(0.0)).alias("mom"),
    )


def cagr_two_years(y: Column, period: int) -> Column:
    """Growth in percent over 2 periods - 1 steps taken as one year; 0 without that history."""
    start = at_age(y, 2 * period)
    return F.when(start > 0, pct(at_age(y, 1), start)).otherwise(dbl(0.0))


def cagr_whole(y: Column, period: int) -> Column:
    """Annualised growth in percent between the first and the last value."""
    first = F.max(F.when(F.col("i") == 0, y))
    ratio = div(at_age(y, 1), first)
    return (F.pow(ratio, dbl(float(period)) / F.count(F.lit(1)).cast("double")) - dbl(1.0)) * dbl(100.0)


def cagr(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return with_index(df, spec).groupBy(*spec.keys).agg(
        cagr_two_years(spec.y, spec.period).alias("cagr_two_years"),
        cagr_whole(spec.y, spec.period).alias("cagr_whole"),
    )


CUTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _distribution_aggs(spec: SeriesSpec) -> list[Column]:
    y = spec.y
    return [
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"),
        F.var_pop(y).alias("variance"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        (F.max(y) - F.min(y)).alias("range"),
        F.percentile(y, F.array(*[dbl(c) for c in CUTS.values()])).alias("_p"),
        (div(F.stddev_pop(y), F.avg(y)) * dbl(100.0)).alias("cv"),
    ]


def _distribution_picks(table: DataFrame, spec: SeriesSpec) -> DataFrame:
    picks = [F.col("_p")[k].alias(name) for k, name in enumerate(CUTS)]
    return table.select("*", *picks, F.col("_p")[2].alias("median")).drop("_p")


DISTRIBUTION = Part(_distribution_aggs, finish=_distribution_picks)


def distribution_stats(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Population moments and percentiles."""
    return DISTRIBUTION.finish(df.groupBy(*spec.keys).agg(*DISTRIBUTION.aggs(spec)), spec)


# Labels given as results, each above its limit, and the label below all limits.
SKEWNESS = (
    (
        (1.0, "Highly right-skewed (positive skew)"),
        (0.5, "Moderately right-skewed"),
        (-0.5, "Approximately symmetric"),
        (-1.0, "Moderately left-skewed"),
    ),
    "Highly left-skewed (negative skew)",
)
KURTOSIS = (
    (
        (3.0, "Heavy-tailed (leptokurtic) - more outliers than normal"),
        (0.0, "Slightly heavy-tailed"),
        (-3.0, "Approximately normal tail weight"),
    ),
    "Light-tailed (platykurtic) - fewer outliers than normal",
)
PACES = ((5.0, "explosive"), (2.0, "strong"), (0.5, "moderate")), "slow"
STRENGTHS = ((0.6, "strong"), (0.3, "moderate"), (0.1, "weak")), "negligible"


def skewness_text(s: Column) -> Column:
    return ladder(s, *SKEWNESS)


def kurtosis_text(k: Column) -> Column:
    return ladder(k, *KURTOSIS)


def _shape_aggs(spec: SeriesSpec) -> list[Column]:
    s, k = F.skewness(spec.y), F.kurtosis(spec.y)
    return [s.alias("skewness"), k.alias("kurtosis"), skewness_text(s).alias("skewness_text"), kurtosis_text(k).alias("kurtosis_text")]


def _jarque_bera_aggs(spec: SeriesSpec) -> list[Column]:
    s, k, n = F.skewness(spec.y), F.kurtosis(spec.y), F.count(spec.y).cast("double")
    stat = n / dbl(6.0) * (s * s + k * k / dbl(4.0))
    p = F.exp(-stat / dbl(2.0))
    return [stat.alias("jb"), p.alias("p_value"), (p > 0.05).alias("is_normal")]


SHAPE, JARQUE_BERA = Part(_shape_aggs), Part(_jarque_bera_aggs)


def skew_kurt(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Population skewness and excess kurtosis with their reading."""
    return df.groupBy(*spec.keys).agg(*_shape_aggs(spec))


def jarque_bera(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.groupBy(*spec.keys).agg(*_jarque_bera_aggs(spec))


# Royston (1995), algorithm AS R94, lowest power first.
SW_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SW_SMALL_STD = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_LARGE_STD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(df: DataFrame, spec: SeriesSpec, order: str | None = None, limit: int = 5000) -> DataFrame:
    """Shapiro-Wilk W of all values of each series, and its p-value.

    The approximation of the p-value holds up to ``limit`` values; longer series have a null
    p-value and verdict.
    """
    age = Window.partitionBy(*spec.keys).orderBy(order or spec.time)
    rows = df.where(spec.y.isNotNull()).withColumn("_place", F.row_number().over(age))
    rank = Window.partitionBy(*spec.keys).orderBy(spec.value, "_place")
    whole = spec.whole()
    rows = rows.withColumns(
        {"_k": F.row_number().over(rank), "_n": F.count(F.lit(1)).over(whole)}
    )
    n = F.col("_n").cast("double")
    rows = rows.withColumn("_m", normal_ppf((F.col("_k") - dbl(0.375)) / (n + dbl(0.25))))
    rows = rows.withColumn("_mm", F.sum(F.col("_m") * F.col("_m")).over(whole))
    u, root = dbl(1.0) / F.sqrt(n), F.sqrt("_mm")
    top = normal_ppf((n - dbl(0.375)) / (n + dbl(0.25)))
    second = normal_ppf((n - dbl(1.375)) / (n + dbl(0.25)))
    a1 = div(top, root) + polynomial(u, SW_LAST[::-1])
    a2 = div(second, root) + polynomial(u, SW_SECOND[::-1])
    rows = rows.withColumns({"_a1": F.when(n == 3, dbl(0.5**0.5)).otherwise(a1), "_a2": a2, "_m1": top, "_m2": second})
    sq = {c: F.col(c) * F.col(c) for c in ("_a1", "_a2", "_m1", "_m2")}
    two = dbl(2.0)
    phi = F.when(
        n > 5,
        div(F.col("_mm") - two * sq["_m1"] - two * sq["_m2"], dbl(1.0) - two * sq["_a1"] - two * sq["_a2"]),
    ).otherwise(div(F.col("_mm") - two * sq["_m1"], dbl(1.0) - two * sq["_a1"]))
    edge = F.least(F.col("_k"), F.col("_n") + 1 - F.col("_k"))
    size = F.when(edge == 1, F.col("_a1")).when((edge == 2) & (n > 5), F.col("_a2")).otherwise(div(F.abs("_m"), F.sqrt(phi)))
    weight = F.when(F.col("_k") * 2 == F.col("_n") + 1, dbl(0.0)).otherwise(F.signum("_m") * size)
    stats = rows.withColumn("_w", weight).groupBy(*spec.keys).agg(
        F.sum(F.col("_w") * spec.y).alias("_b"), (F.var_pop(spec.y) * F.count(spec.y)).alias("_ss"), F.max("_n").alias("n")
    )
    w = F.least(div(F.col("_b") * F.col("_b"), F.col("_ss")), dbl(1.0))
    stats = stats.withColumn("w", F.when(F.col("n") >= 3, w)).drop("_b", "_ss")
    # one step per column: nested, these expressions would be evaluated many times over
    n, w = F.col("n").cast("double"), F.col("w")
    stats = stats.withColumns({"_miss": F.log(dbl(1.0) - w), "_size": F.log(n)})
    miss, size = F.col("_miss"), F.col("_size")
    gamma = dbl(-2.273) + dbl(0.459) * n
    small_z = (-F.log(gamma - miss) - polynomial(n, SW_SMALL_MEAN[::-1])) / F.exp(polynomial(n, SW_SMALL_STD[::-1]))
    large_z = (miss - polynomial(size, SW_LARGE_MEAN[::-1])) / F.exp(polynomial(size, SW_LARGE_STD[::-1]))
    stats = stats.withColumn("_z", F.when(n <= 11, small_z).otherwise(large_z))
    three = F.greatest(dbl(1.90985931710274) * (F.asin(F.sqrt(w)) - dbl(1.0471975511966)), dbl(0.0))
    p = (
        F.when(n == 3, three)
        .when(w >= 1.0, dbl(1.0))
        .when((n <= 11) & (miss >= gamma), dbl(0.0))
        .otherwise(dbl(1.0) - normal_cdf(F.col("_z")))
    )
    stats = stats.withColumn("p_value", F.when(F.col("n") <= limit, p)).drop("_miss", "_size", "_z")
    return stats.withColumn("is_normal", F.col("p_value") > 0.05)


def histogram_density(df: DataFrame, spec: SeriesSpec, bins: int = 30) -> DataFrame:
    """Equal-width bins with density, and the normal fit; empty bins included."""
    whole = spec.whole()
    y = spec.y
    rows = df.where(y.isNotNull()).withColumns(
        {"_lo": F.min(spec.value).over(whole), "_hi": F.max(spec.value).over(whole)}
    )
    width = (F.col("_hi") - F.col("_lo")) / dbl(float(bins))
    slot = F.least(F.floor(div(y - F.col("_lo"), width)) + 1, F.lit(bins))
    rows = rows.withColumn("_slot", slot)
    counts = F.array(*[F.count_if(F.col("_slot") == b) for b in range(1, bins + 1)])
    fits = rows.groupBy(*spec.keys).agg(
        counts.alias("_counts"), F.count(F.lit(1)).alias("_n"), F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"), F.avg(y).alias("mu"), F.stddev_pop(y).alias("sigma"),
    )
    out = fits.select("*", F.posexplode("_counts").alias("_at", "count"))
    out = out.withColumn("bin", F.col("_at") + 1).withColumn("left_edge", F.col("_lo") + width * F.col("_at"))
    density = div(F.col("count").cast("double"), F.col("_n") * width)
    return out.select(*spec.keys, "bin", "left_edge", "count", density.alias("density"), "mu", "sigma")


def qq_points(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Sample against normal order-statistic medians, with the fitted line."""
    whole = spec.whole()
    rank = Window.partitionBy(*spec.keys).orderBy(spec.value, spec.time)
    rows = df.where(spec.y.isNotNull()).withColumns(
        {"rank": F.row_number().over(rank), "_n": F.count(F.lit(1)).over(whole)}
    )
    n, k = F.col("_n").cast("double"), F.col("rank").cast("double")
    last = F.pow(dbl(0.5), dbl(1.0) / n)
    median = F.when(k == n, last).when(k == 1, dbl(1.0) - last).otherwise((k - dbl(0.3175)) / (n + dbl(0.365)))
    rows = rows.withColumn("theoretical", normal_ppf(median))
    t = F.col("theoretical")
    return rows.select(
        *spec.keys, "rank", "theoretical", spec.y.alias("sample"),
        F.regr_slope(spec.y, t).over(whole).alias("slope"),
        F.regr_intercept(spec.y, t).over(whole).alias("intercept"),
    )


# -- trend -------------------------------------------------------------------


def _polynomial_rows(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The centred index ``_x`` of a complete series and its even moments."""
    rows = rows.withColumn("_x", F.col("i").cast("double") - (F.col("n").cast("double") - dbl(1.0)) / dbl(2.0))
    return rows.withColumns(
        {
            "_m2": F.avg(F.col("_x") * F.col("_x")).over(spec.whole()),
            "_m4": F.avg(F.pow("_x", F.lit(4.0))).over(spec.whole()),
        }
    )


def _polynomial_aggs(spec: SeriesSpec) -> list[Column]:
    c, y = F.col("_x"), spec.y
    p2 = c * c - F.col("_m2")
    p3 = c * c * c - c * div(F.col("_m4"), F.col("_m2"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.first("_m2").alias("_m2"),
        F.first(div(F.col("_m4"), F.col("_m2"))).alias("_k"),
        F.sum(y * c).alias("_y1"), F.sum(c * c).alias("_s1"),
        F.sum(y * p2).alias("_y2"), F.sum(p2 * p2).alias("_s2"),
        F.sum(y * p3).alias("_y3"), F.sum(p3 * p3).alias("_s3"),
    ]


def _projections(fits: DataFrame) -> DataFrame:
    """Projections on the first orthogonal polynomials of the index and the share each explains.

    On a regular grid centred at its middle, x and x^2 - mean are orthogonal and
    x^3 only needs its x part removed, so least squares takes no matrix solve.
    """
    for d in (1, 2, 3):
        fits = fits.withColumn(f"b{d}", F.when(F.col("n") > d, div(F.col(f"_y{d}"), F.col(f"_s{d}"))))
        fits = fits.withColumn(f"g{d}", div(F.col(f"b{d}") * F.col(f"_y{d}"), F.col("sst")))
    return fits


POLYNOMIAL = Part(_polynomial_aggs, _polynomial_rows, lambda fits, spec: _projections(fits))


def _raw_coefficients(degree: int) -> list[Column]:
    """Coefficients in powers of the row index, constant first."""
    h = (F.col("n").cast("double") - dbl(1.0)) / dbl(2.0)
    mean, m2, k = F.col("mean"), F.col("_m2"), F.col("_k")
    b1 = F.col("b1")
    b2 = F.col("b2") if degree >= 2 else dbl(0.0)
    b3 = F.col("b3") if degree >= 3 else dbl(0.0)
    a0 = mean - b1 * h + b2 * (h * h - m2) + b3 * (k * h - h * h * h)
    a1 = b1 - dbl(2.0) * b2 * h + b3 * (dbl(3.0) * h * h - k)
    a2 = b2 - dbl(3.0) * b3 * h
    return [a0, a1, a2, b3][: degree + 1]


def _trend(df: DataFrame, spec: SeriesSpec, degree: int) -> DataFrame:
    fits = alone(df, spec, POLYNOMIAL)
    names = ["intercept", "slope", "quadratic", "cubic"]
    r2 = sum((F.col(f"g{d}") for d in range(2, degree + 1)), F.col("g1"))
    coefficients = [c.alias(name) for c, name in zip(_raw_coefficients(degree), names)]
    return fits.select(*spec.keys, *coefficients, r2.alias("r2"))


def trend_linear(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _trend(df, spec, 1)


def trend_quadratic(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _trend(df, spec, 2)


def trend_cubic(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return _trend(df, spec, 3)


def _exponential_rows(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    x, logs, whole = F.col("i").cast("double"), F.log(spec.y + dbl(1.0)), spec.whole()
    return rows.withColumns({"_rate": F.regr_slope(logs, x).over(whole), "_level": F.regr_intercept(logs, x).over(whole)})


def _exponential_aggs(spec: SeriesSpec) -> list[Column]:
    miss = spec.y - (F.exp(F.col("_rate") * F.col("i").cast("double") + F.col("_level")) - dbl(1.0))
    return [
        F.first("_level").alias("intercept"),
        F.first("_rate").alias("rate"),
        (dbl(1.0) - div(F.sum(miss * miss), F.var_pop(spec.y) * F.count(spec.y))).alias("r2"),
    ]


EXPONENTIAL = Part(_exponential_aggs, _exponential_rows)


def trend_exponential(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Line through log(y + 1); R2 measured on the original scale."""
    return alone(df, spec, EXPONENTIAL)


def _trend_reading(fits: DataFrame, spec: SeriesSpec) -> DataFrame:
    out = _projections(fits).select(
        *spec.keys, F.col("mean"), F.col("b1").alias("linear_slope"), F.col("g1").alias("linear_r2"),
        (F.col("g1") + F.col("g2")).alias("polynomial_r2"), F.col("rate").alias("exponential_rate"), F.col("r2").alias("exponential_r2"),
    )
    kind = (
        F.when(F.col("linear_r2") > 0.95, F.lit("strong_linear"))
        .when(F.col("exponential_r2") > 0.95, F.lit("strong_exponential"))
        .when(F.col("polynomial_r2") > 0.95, F.lit("polynomial"))
        .when(F.col("linear_r2") > 0.80, F.lit("weak_linear"))
        .otherwise(F.lit("non_linear"))
    )
    pace = ladder(
        div(F.col("linear_slope"), F.col("mean")) * dbl(100.0),
        *PACES,
    )
    out = out.withColumn("trend_type", kind)
    text = F.concat(
        F.lit("Data shows "), pace, F.lit(" growth with "), F.replace(F.col("trend_type"), F.lit("_"), F.lit(" ")), F.lit(" pattern")
    )
    return out.withColumn("interpretation", text).drop("mean")


TREND = Part(
    lambda spec: [*_polynomial_aggs(spec), *_exponential_aggs(spec)],
    lambda rows, spec: _exponential_rows(_polynomial_rows(rows, spec), spec),
    _trend_reading,
)


def trend_type(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Which trend shape explains the series, and how fast it grows."""
    return alone(df, spec, TREND)


# -- seasonality -------------------------------------------------------------


def monthly_pattern(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Statistics per month of year and the factor over the series mean."""
    return _pattern(df, spec, F.month(spec.t), "month")


def quarterly_pattern(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Statistics per quarter, the factor over the series mean, and the strongest quarter."""
    out = _pattern(df, spec, F.quarter(spec.t), "quarter")
    best = F.max_by("quarter", F.struct(F.col("seasonal_factor"), -F.col("quarter"))).over(spec.whole())
    return out.withColumn("strongest_quarter", best)


def _by_part(df: DataFrame, spec: SeriesSpec, part: Column, name: str) -> DataFrame:
    """Statistics per part of the year with the mean of the series and the sum of squares inside each part."""
    y, whole = spec.y, spec.whole()
    by_part = df.groupBy(*spec.keys, part.alias(name)).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.count(y).alias("count"),
        F.min(y).alias("min"), F.max(y).alias("max"), F.sum(y).alias("_sum"), (F.var_pop(y) * F.count(y)).alias("_within"),
    )
    out = by_part.withColumn("overall_mean", div(F.sum("_sum").over(whole), F.sum("count").over(whole))).drop("_sum")
    out = out.withColumn("seasonal_factor", div(F.col("mean"), F.col("overall_mean")))
    return out.withColumn("is_peak", F.col("seasonal_factor") > 1.1).withColumn("is_low", F.col("seasonal_factor") < 0.9)


def _pattern(df: DataFrame, spec: SeriesSpec, part: Column, name: str) -> DataFrame:
    return _by_part(df, spec, part, name).drop("_within")


def seasonal_strength(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Variance of month means over the variance of the series (both sample)."""
    return season(df, spec).select(*spec.keys, "strength", "strength_label")


def season(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series: strength of the season and its label, the months' statistics in order, and the names of peak months."""
    months = _by_part(df, spec, F.month(spec.t), "month")
    fields = [c for c in months.columns if c not in (*spec.keys, "_within")]
    gap = F.col("mean") - F.col("overall_mean")
    # total sum of squares = within months + between months around the grand mean
    total = F.sum(F.col("_within") + F.col("count") * gap * gap)
    out = months.groupBy(*spec.keys).agg(
        F.var_samp("mean").alias("_between"), div(total, F.sum("count") - dbl(1.0)).alias("_total"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("months"),
    )
    strength = div(F.col("_between"), F.col("_total"))
    label = F.when(F.col("_total") == 0, F.lit("none")).otherwise(
        ladder(strength, *STRENGTHS)
    )
    peaks = F.transform(F.filter("months", lambda m: m["is_peak"]), lambda m: m["month"].cast("string"))
    return out.select(
        *spec.keys, strength.alias("strength"), label.alias("strength_label"), "months", F.array_join(peaks, ", ").alias("peaks")
    )


# -- growth ------------------------------------------------------------------


def growth_trajectory(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Latest value, a season ago, averages of the last two seasons, acceleration and direction."""
    p, y = spec.period, spec.y
    rows = with_index(df, spec).withColumn("_diff", spec.y - F.lag(spec.value).over(spec.ordered()))
    age = F.col("age")
    recent, earlier = age <= p, (age > p) & (age <= 2 * p)
    # differences inside a season: its oldest row has no predecessor within the season
    recent_step = F.avg(F.when(recent & (age != p), F.col("_diff")))
    earlier_step = F.avg(F.when(earlier & (age != 2 * p) & (F.col("i") > 0), F.col("_diff")))
    recent_mean, earlier_mean = F.avg(F.when(recent, y)), F.avg(F.when(earlier, y))
    return rows.groupBy(*spec.keys).agg(
        at_age(y, 1).alias("current_volume"),
        at_age(y, p + 1).alias("volume_12_months_ago"),
        recent_mean.alias("recent_12m_avg"),
        earlier_mean.alias("prev_12m_avg"),
        F.coalesce(pct(recent_mean, earlier_mean), dbl(0.0)).alias("acceleration"),
        pct(at_age(y, 1), at_age(y, p + 1)).alias("yoy_growth_latest"),
        pct(at_age(y, 1), at_age(y, 2)).alias("mom_growth_latest"),
        F.when(recent_step > earlier_step, F.lit("accelerating")).otherwise(F.lit("decelerating")).alias("trend_direction"),
    )


def reach_target(df: DataFrame, spec: SeriesSpec, targets: list[float], as_of: str) -> DataFrame:
    """Month in which the recent trend reaches each target, counted from ``as_of``."""
    rows = with_index(df, spec).where(F.col("age") <= 6)
    x = F.col("i").cast("double")
    fits = rows.groupBy(*spec.keys).agg(
        at_age(spec.y, 1).alias("latest"), F.count(F.lit(1)).alias("_n"), F.regr_slope(spec.y, x).alias("slope")
    )
    out = fits.withColumn("target", F.explode(F.array(*[dbl(t) for t in targets])))
    # truncation, not rounding: both parts are positive here
    months = F.floor(div(F.col("target") - F.col("latest"), F.col("slope")))
    when = F.date_format(F.add_months(F.lit(as_of).cast("date"), F.least(months, F.lit(61)).cast("int")), "yyyy-MM")
    verdict = (
        F.when(F.col("latest") >= F.col("target"), F.lit("Already reached"))
        .when(F.col("_n") < 6, F.lit("Insufficient data"))
        .when(F.col("slope") <= 0, F.lit("Trend unclear"))
        .when(months > 60, F.lit(">5 years"))
        .otherwise(when)
    )
    return out.select(*spec.keys, "target", "latest", "slope", verdict.alias("reached"))


def growth_insights(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Growth wording, all-time high and its month, momentum of the last half seasons, festive boost."""
    p, y = spec.period, spec.y
    half = p // 2
    rows = with_index(df, spec).withColumn("_diff", spec.y - F.lag(spec.value).over(spec.ordered()))
    age = F.col("age")
    recent = F.avg(F.when(age <= half, F.col("_diff")))
    earlier = F.avg(F.when((age > half) & (age <= p), F.col("_diff")))
    november = div(F.avg(F.when(F.month(spec.t) == 11, y)), F.avg(y))
    out = rows.groupBy(*spec.keys).agg(
        at_age(y, 1).alias("current"),
        at_age(y, p + 1).alias("year_ago"),
        F.max(y).alias("all_time_high"),
        month_label(F.min_by(spec.time, F.struct(-y, spec.t))).alias("all_time_high_date"),
        F.avg(y).alias("mean"),
        F.coalesce(pct(at_age(y, 1), at_age(y, p + 1)), dbl(0.0)).alias("yoy_growth_pct"),
        F.coalesce(pct(at_age(y, 1), at_age(y, 2)), dbl(0.0)).alias("mom_growth_pct"),
        F.when(recent > earlier, F.lit("accelerating")).otherwise(F.lit("decelerating")).alias("trend"),
        F.coalesce((november - dbl(1.0)) * dbl(100.0), dbl(0.0)).alias("festive_boost_pct"),
    )
    word = ladder(F.col("yoy_growth_pct"), ((50.0, "explosive"), (25.0, "strong")), "moderate")
    boost = F.format_string("Oct-Dec shows %.1f%% higher activity", stable_round(F.col("festive_boost_pct"), 1))
    return out.withColumn("interpretation", word).withColumn(
        "seasonality_text", F.when(F.col("festive_boost_pct") > 5, boost).otherwise(F.lit("Seasonal patterns present"))
    )
