"""Summary statistics, trends, seasonality, growth and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import describe as ds
from tidemill.operators import stattests as st
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs
from tidemill.plans.sqlmath import poly, ppf, cdf

SEG = tb.SEGMENT
G = f"WITH {tb.SEGMENT_GRID_SQL}"
CG = tb.CUSTOMER_SQL  # one row per active month, index by order


def series(spark, folder):
    return tb.segment_grid(spark, folder).drop("n")


def line(spark, folder):
    return tb.line_series(spark, folder).drop("n")


def at(age: int, v: str = "y") -> str:
    return f"MAX({v}) FILTER (age = {age})"


def growth(v: str, k: int) -> str:
    return f"COALESCE(({at(1, v)} - {at(k, v)}) / NULLIF({at(k, v)}, 0) * 100, 0)"


LINE_I = f"""WITH {tb.LINE_SQL},
li AS (SELECT *, row_number() OVER k - 1 AS i, COUNT(*) OVER (PARTITION BY returnflag, linestatus) AS len,
              y - LAG(y) OVER k AS d FROM line WINDOW k AS (PARTITION BY returnflag, linestatus ORDER BY date)),
la AS (SELECT *, len - i AS age FROM li)
"""

GI = G + """,
gi AS (SELECT *, len - i AS age, y - LAG(y) OVER (PARTITION BY segment ORDER BY date) AS d FROM g)
"""


@query(
    "series_summary",
    f"""{LINE_I} SELECT returnflag, linestatus, COUNT(*) AS total_records,
        strftime(MIN(date), '%Y-%m') AS start, strftime(MAX(date), '%Y-%m') AS "end",
        {rs('mean=AVG(y)', 'std=STDDEV_SAMP(y)', 'min=MIN(y)', 'max=MAX(y)', f'latest={at(1)}', 'median=MEDIAN(y)',
            'q1=quantile_cont(y, 0.25)', 'q3=quantile_cont(y, 0.75)', f'yoy={growth("y", 13)}', f'mom={growth("y", 2)}',
            f'cagr=CASE WHEN {at(24)} > 0 THEN ({at(1)} - {at(24)}) / {at(24)} * 100 ELSE 0 END',
            'cv=STDDEV_SAMP(y) / NULLIF(AVG(y), 0) * 100', 'diff_std=STDDEV_SAMP(d)',
            'quantity_mean=AVG(quantity)', 'quantity_std=STDDEV_SAMP(quantity)', 'quantity_min=MIN(quantity)',
            'quantity_max=MAX(quantity)', f'quantity_latest={at(1, "quantity")}',
            f'quantity_yoy={growth("quantity", 13)}', f'quantity_mom={growth("quantity", 2)}')}
        FROM la GROUP BY 1, 2""",
)
def series_summary(spark, folder):
    return ds.series_summary(line(spark, folder), tb.LINE, "quantity")


@query("yoy_mom_latest", f"{GI} SELECT segment, {rs(f'yoy={growth('y', 13)}', f'mom={growth('y', 2)}')} FROM gi GROUP BY 1")
def yoy_mom_latest(spark, folder):
    return ds.yoy_mom_latest(series(spark, folder), SEG)


@query(
    "cagr",
    f"""{GI} SELECT segment,
        {rs(f'cagr_two_years=CASE WHEN {at(24)} > 0 THEN ({at(1)} - {at(24)}) / {at(24)} * 100 ELSE 0 END',
            f'cagr_whole=(pow({at(1)} / NULLIF(MAX(y) FILTER (i = 0), 0), 12e0 / COUNT(*)) - 1) * 100')}
        FROM gi GROUP BY 1""",
)
def cagr(spark, folder):
    return ds.cagr(series(spark, folder), SEG)


@query(
    "distribution_stats",
    f"""{G} SELECT segment, {rs('mean=AVG(y)', 'std=STDDEV_POP(y)', 'variance=VAR_POP(y)', 'min=MIN(y)', 'max=MAX(y)',
        'range=MAX(y) - MIN(y)', 'cv=STDDEV_POP(y) / NULLIF(AVG(y), 0) * 100', 'p5=quantile_cont(y, 0.05)',
        'p25=quantile_cont(y, 0.25)', 'p50=quantile_cont(y, 0.5)', 'p75=quantile_cont(y, 0.75)',
        'p95=quantile_cont(y, 0.95)', 'median=MEDIAN(y)')} FROM g GROUP BY 1""",
)
def distribution_stats(spark, folder):
    return ds.distribution_stats(series(spark, folder), SEG)


SHAPE_CTE = """,
mm AS (SELECT segment, AVG(y) AS m FROM g GROUP BY 1),
sh AS (SELECT segment, COUNT(*) AS c, AVG(pow(y - m, 2)) AS m2, AVG(pow(y - m, 3)) AS m3, AVG(pow(y - m, 4)) AS m4
       FROM g JOIN mm USING (segment) GROUP BY 1),
sk AS (SELECT segment, c, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM sh)
"""


@query(
    "skew_kurt",
    f"""{G}{SHAPE_CTE} SELECT segment, {rs('skewness', 'kurtosis')},
        CASE WHEN skewness > 1 THEN 'Highly right-skewed (positive skew)' WHEN skewness > 0.5 THEN 'Moderately right-skewed'
             WHEN skewness > -0.5 THEN 'Approximately symmetric' WHEN skewness > -1 THEN 'Moderately left-skewed'
             ELSE 'Highly left-skewed (negative skew)' END AS skewness_text,
        CASE WHEN kurtosis > 3 THEN 'Heavy-tailed (leptokurtic) - more outliers than normal'
             WHEN kurtosis > 0 THEN 'Slightly heavy-tailed' WHEN kurtosis > -3 THEN 'Approximately normal tail weight'
             ELSE 'Light-tailed (platykurtic) - fewer outliers than normal' END AS kurtosis_text FROM sk""",
)
def skew_kurt(spark, folder):
    return ds.skew_kurt(series(spark, folder), SEG)


@query(
    "jarque_bera",
    f"""{G}{SHAPE_CTE}, j AS (SELECT segment, c / 6e0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jb FROM sk)
        SELECT segment, {rs('jb', 'p_value=exp(-jb / 2)')}, exp(-jb / 2) > 0.05 AS is_normal FROM j""",
)
def jarque_bera(spark, folder):
    return ds.jarque_bera(series(spark, folder), SEG)


@query(
    "shapiro_wilk",
    f"""{G},
        a AS (SELECT segment, y, row_number() OVER (PARTITION BY segment ORDER BY y, date) AS k, CAST(len AS DOUBLE) AS n FROM g),
        b AS (SELECT *, (k - 0.375) / (n + 0.25) AS p, (n - 0.375) / (n + 0.25) AS p1, (n - 1.375) / (n + 0.25) AS p2 FROM a),
        c AS (SELECT *, {ppf('p')} AS m, {ppf('p1')} AS m1, {ppf('p2')} AS m2, 1 / sqrt(n) AS u FROM b),
        d AS (SELECT *, SUM(m * m) OVER (PARTITION BY segment) AS mm FROM c),
        e AS (SELECT *, m1 / sqrt(mm) + {poly('u', ds.SW_LAST[::-1])} AS a1, m2 / sqrt(mm) + {poly('u', ds.SW_SECOND[::-1])} AS a2 FROM d),
        f AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM e),
        h AS (SELECT segment, n, y, CASE WHEN k = 1 THEN -a1 WHEN k = 2 THEN -a2 WHEN k = n THEN a1 WHEN k = n - 1 THEN a2
                     ELSE m / sqrt(phi) END AS w FROM f),
        s AS (SELECT segment, CAST(MAX(n) AS BIGINT) AS n, pow(SUM(w * y), 2) / (VAR_POP(y) * COUNT(*)) AS w FROM h GROUP BY 1),
        z AS (SELECT *, (ln(1 - w) - {poly('ln(n)', ds.SW_LARGE_MEAN[::-1])}) / exp({poly('ln(n)', ds.SW_LARGE_STD[::-1])}) AS z FROM s),
        q AS (SELECT *, 1 - {cdf('z')} AS p_value FROM z)
        SELECT segment, n, {rs('w', 'p_value')}, p_value > 0.05 AS is_normal FROM q""",
)
def shapiro_wilk(spark, folder):
    return ds.shapiro_wilk(series(spark, folder), SEG)


@query(
    "histogram_density",
    f"""{G}, b AS (SELECT segment, MIN(y) AS lo, MAX(y) AS hi, (MAX(y) - MIN(y)) / 30 AS w, COUNT(*) AS c, AVG(y) AS mu,
                     STDDEV_POP(y) AS sigma FROM g GROUP BY 1),
        k AS (SELECT g.segment, LEAST(floor((y - lo) / w) + 1, 30) AS bin FROM g JOIN b USING (segment)),
        h AS (SELECT segment, bin, COUNT(*) AS c FROM k GROUP BY 1, 2)
        SELECT b.segment, CAST(t.bin AS BIGINT) AS bin, {r('lo + w * (t.bin - 1)', 'left_edge')}, COALESCE(h.c, 0) AS count,
               {r('COALESCE(h.c, 0) / (b.c * w)', 'density')}, {rs('mu', 'sigma')}
        FROM b CROSS JOIN range(1, 31) t(bin) LEFT JOIN h ON h.segment = b.segment AND h.bin = t.bin""",
)
def histogram_density(spark, folder):
    return ds.histogram_density(series(spark, folder), SEG)


@query(
    "qq_points",
    f"""{G}, a AS (SELECT segment, y, row_number() OVER (PARTITION BY segment ORDER BY y, date) AS rank, CAST(len AS DOUBLE) AS n FROM g),
        b AS (SELECT *, CASE WHEN rank = n THEN pow(0.5, 1 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1 / n)
                         ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM a),
        c AS (SELECT *, {ppf('p')} AS t FROM b)
        SELECT segment, rank, {rs('theoretical=t', 'sample=y', 'slope=regr_slope(y, t) OVER (PARTITION BY segment)',
                                  'intercept=regr_intercept(y, t) OVER (PARTITION BY segment)')} FROM c""",
)
def qq_points(spark, folder):
    return ds.qq_points(series(spark, folder), SEG)


# -- trend -------------------------------------------------------------------

# x centred on the series middle is uncorrelated with x squared on a regular grid,
# and x cubed only needs its linear part taken out
FIT_CTE = """,
ct AS (SELECT *, i - (len - 1) / 2e0 AS c, (len - 1) / 2e0 AS h FROM g),
c3 AS (SELECT *, c * c * c - c * regr_slope(c * c * c, c) OVER (PARTITION BY segment) AS q,
              regr_slope(c * c * c, c) OVER (PARTITION BY segment) AS k FROM ct),
ft AS (SELECT segment, MAX(h) AS h, MAX(k) AS k, AVG(y) AS m, AVG(c * c) AS m2, regr_slope(y, c) AS b1, regr_r2(y, c) AS r1,
              regr_slope(y, c * c) AS b2, regr_r2(y, c * c) AS r2, regr_slope(y, q) AS b3, regr_r2(y, q) AS r3
       FROM c3 GROUP BY 1)
"""


@query("trend_linear", f"{G} SELECT segment, {rs('intercept=regr_intercept(y, i)', 'slope=regr_slope(y, i)', 'r2=regr_r2(y, i)')} FROM g GROUP BY 1")
def trend_linear(spark, folder):
    return ds.trend_linear(series(spark, folder), SEG)


@query(
    "trend_quadratic",
    f"""{G}{FIT_CTE} SELECT segment, {rs('intercept=m - b1 * h + b2 * (h * h - m2)', 'slope=b1 - 2 * b2 * h', 'quadratic=b2', 'r2=r1 + r2')} FROM ft""",
)
def trend_quadratic(spark, folder):
    return ds.trend_quadratic(series(spark, folder), SEG)


@query(
    "trend_cubic",
    f"""{G}{FIT_CTE} SELECT segment, {rs('intercept=m - b1 * h + b2 * (h * h - m2) + b3 * (k * h - h * h * h)',
        'slope=b1 - 2 * b2 * h + b3 * (3 * h * h - k)', 'quadratic=b2 - 3 * b3 * h', 'cubic=b3', 'r2=r1 + r2 + r3')} FROM ft""",
)
def trend_cubic(spark, folder):
    return ds.trend_cubic(series(spark, folder), SEG)


EXP_CTE = """,
ex AS (SELECT segment, regr_slope(ln(y + 1), i) AS b, regr_intercept(ln(y + 1), i) AS a, VAR_POP(y) * COUNT(*) AS sst FROM g GROUP BY 1),
er AS (SELECT segment, MAX(a) AS a, MAX(b) AS b, 1 - SUM(pow(y - (exp(b * i + a) - 1), 2)) / MAX(sst) AS er2 FROM g JOIN ex USING (segment) GROUP BY 1)
"""


@query("trend_exponential", f"{G}{EXP_CTE} SELECT segment, {rs('intercept=a', 'rate=b', 'r2=er2')} FROM er")
def trend_exponential(spark, folder):
    return ds.trend_exponential(series(spark, folder), SEG)


@query(
    "trend_type",
    f"""{G}{FIT_CTE}{EXP_CTE},
        tt AS (SELECT segment, b1, m, r1, r1 + r2 AS pr, er2, er.b AS rate,
                      CASE WHEN r1 > 0.95 THEN 'strong_linear' WHEN er2 > 0.95 THEN 'strong_exponential'
                           WHEN r1 + r2 > 0.95 THEN 'polynomial' WHEN r1 > 0.8 THEN 'weak_linear' ELSE 'non_linear' END AS trend_type
               FROM ft JOIN er USING (segment))
        SELECT segment, {rs('linear_slope=b1', 'linear_r2=r1', 'polynomial_r2=pr', 'exponential_rate=rate', 'exponential_r2=er2')},
               trend_type, 'Data shows ' || CASE WHEN b1 / m * 100 > 5 THEN 'explosive' WHEN b1 / m * 100 > 2 THEN 'strong'
                 WHEN b1 / m * 100 > 0.5 THEN 'moderate' ELSE 'slow' END || ' growth with ' || replace(trend_type, '_', ' ') || ' pattern'
                 AS interpretation FROM tt""",
)
def trend_type(spark, folder):
    return ds.trend_type(series(spark, folder), SEG)


# -- seasonality -------------------------------------------------------------


def pattern_sql(part: str, extra: str = "") -> str:
    return f"""{G}, o AS (SELECT segment, AVG(y) AS om FROM g GROUP BY 1),
        p AS (SELECT segment, {part}(date) AS {part}, AVG(y) AS mean, STDDEV_SAMP(y) AS std, COUNT(y) AS count, MIN(y) AS min, MAX(y) AS max
              FROM g GROUP BY 1, 2)
        SELECT segment, {part}, {rs('mean', 'std', 'min', 'max', 'overall_mean=om', 'seasonal_factor=mean / om')}, count,
               mean / om > 1.1 AS is_peak, mean / om < 0.9 AS is_low{extra} FROM p JOIN o USING (segment)"""


@query("monthly_pattern", pattern_sql("month"))
def monthly_pattern(spark, folder):
    return ds.monthly_pattern(series(spark, folder), SEG)


@query(
    "quarterly_pattern",
    pattern_sql("quarter", ", FIRST_VALUE(quarter) OVER (PARTITION BY segment ORDER BY mean DESC, quarter) AS strongest_quarter"),
)
def quarterly_pattern(spark, folder):
    return ds.quarterly_pattern(series(spark, folder), SEG)


@query(
    "seasonal_strength",
    f"""{G}, p AS (SELECT segment, month(date) AS mo, AVG(y) AS m FROM g GROUP BY 1, 2),
        v AS (SELECT segment, VAR_SAMP(m) AS b FROM p GROUP BY 1), t AS (SELECT segment, VAR_SAMP(y) AS t FROM g GROUP BY 1),
        s AS (SELECT segment, t, b / NULLIF(t, 0) AS strength FROM v JOIN t USING (segment))
        SELECT segment, {rs('strength')}, CASE WHEN t = 0 THEN 'none' WHEN strength > 0.6 THEN 'strong' WHEN strength > 0.3 THEN 'moderate'
               WHEN strength > 0.1 THEN 'weak' ELSE 'negligible' END AS strength_label FROM s""",
)
def seasonal_strength(spark, folder):
    return ds.seasonal_strength(series(spark, folder), SEG)


# -- growth ------------------------------------------------------------------


@query(
    "growth_trajectory",
    f"""{GI}, t AS (SELECT segment, {at(1)} AS a1, {at(2)} AS a2, {at(13)} AS a13, AVG(y) FILTER (age <= 12) AS rm,
               AVG(y) FILTER (age > 12 AND age <= 24) AS em, AVG(d) FILTER (age < 12) AS rd, AVG(d) FILTER (age > 12 AND age < 24) AS ed
        FROM gi GROUP BY 1)
        SELECT segment, {rs('current_volume=a1', 'volume_12_months_ago=a13', 'recent_12m_avg=rm', 'prev_12m_avg=em',
            'acceleration=(rm - em) / em * 100', 'yoy_growth_latest=(a1 - a13) / a13 * 100', 'mom_growth_latest=(a1 - a2) / a2 * 100')},
            CASE WHEN rd > ed THEN 'accelerating' ELSE 'decelerating' END AS trend_direction FROM t""",
)
def growth_trajectory(spark, folder):
    return ds.growth_trajectory(series(spark, folder), SEG)


REACH_SQL = f"""{GI}, s AS (SELECT segment, {at(1)} AS latest, COUNT(*) AS c, regr_slope(y, i) AS slope FROM gi WHERE age <= 6 GROUP BY 1),
x AS (SELECT *, floor((target - latest) / NULLIF(slope, 0)) AS k FROM s CROSS JOIN (VALUES (2e0), (6e0), (100e0)) v(target))
SELECT segment, {rs('target', 'latest', 'slope')},
  CASE WHEN latest >= target THEN 'Already reached' WHEN c < 6 THEN 'Insufficient data' WHEN slope <= 0 THEN 'Trend unclear'
       WHEN k > 60 THEN '>5 years' ELSE strftime(DATE '2001-09-01' + to_months(CAST(LEAST(k, 61) AS INTEGER)), '%Y-%m') END AS reached
FROM x"""


@query("reach_target", REACH_SQL)
def reach_target(spark, folder):
    return ds.reach_target(series(spark, folder), SEG, [2.0, 6.0, 100.0], "2001-09-01")


@query(
    "growth_insights_c",
    f"""{GI}, t AS (SELECT segment, {at(1)} AS a1, {at(13)} AS a13, MAX(y) AS ath, AVG(y) AS m, arg_max(date, y) AS athd,
               {growth('y', 13)} AS yoy, {growth('y', 2)} AS mom,
               AVG(d) FILTER (age <= 6) AS rd, AVG(d) FILTER (age > 6 AND age <= 12) AS ed,
               COALESCE((AVG(y) FILTER (month(date) = 11) / AVG(y) - 1) * 100, 0) AS fb FROM gi GROUP BY 1)
        SELECT segment, {rs('current=a1', 'year_ago=a13', 'all_time_high=ath', 'mean=m', 'yoy_growth_pct=yoy', 'mom_growth_pct=mom', 'festive_boost_pct=fb')},
               strftime(athd, '%Y-%m') AS all_time_high_date, CASE WHEN rd > ed THEN 'accelerating' ELSE 'decelerating' END AS trend,
               CASE WHEN yoy > 50 THEN 'explosive' WHEN yoy > 25 THEN 'strong' ELSE 'moderate' END AS interpretation,
               CASE WHEN fb > 5 THEN printf('Oct-Dec shows %.1f%% higher activity', {r('fb', digits=1)})
                    ELSE 'Seasonal patterns present' END AS seasonality_text FROM t""",
)
def growth_insights(spark, folder):
    return ds.growth_insights(series(spark, folder), SEG)


# -- autocorrelation ---------------------------------------------------------


def acf_cte(source: str, lags: int = 24) -> str:
    return f""",
cd AS (SELECT segment, i, y - AVG(y) OVER (PARTITION BY segment) AS d, COUNT(*) OVER (PARTITION BY segment) AS n FROM {source}),
cl AS (SELECT a.segment, MAX(a.n) AS n, l.lag, SUM(a.d * b.d) AS s FROM cd a CROSS JOIN range(0, {lags + 1}) l(lag)
       JOIN cd b ON b.segment = a.segment AND b.i = a.i - l.lag GROUP BY 1, 3),
c0 AS (SELECT segment, s AS s0 FROM cl WHERE lag = 0),
ac AS (SELECT cl.segment, n, lag, s / s0 AS acf, 1.96 / sqrt(n) AS band FROM cl JOIN c0 USING (segment))
"""


PACF_CTE = """,
pa AS (SELECT segment, list(acf ORDER BY lag) AS rr, MAX(n) AS n FROM ac GROUP BY 1),
pk AS (
  SELECT segment, rr, n, 1 AS k, rr[2] AS last, [rr[2]] AS phi FROM pa
  UNION ALL
  SELECT segment, rr, n, k + 1, nl, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - nl * phi[k + 1 - j]), [nl])
  FROM (SELECT *, (rr[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rr[k + 2 - j])))
                  / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rr[j + 1]))) AS nl FROM pk WHERE k + 2 <= len(rr))),
pf AS (SELECT segment, 0 AS lag, 1e0 AS pacf FROM pa UNION ALL SELECT segment, k, last FROM pk)
"""
GREC = f"WITH RECURSIVE {tb.SEGMENT_GRID_SQL}"


@query(
    "acf",
    f"{G}{acf_cte('g')} SELECT segment, lag, {rs('acf', 'band')}, lag > 0 AND ABS(acf) > band AS is_significant FROM ac",
)
def acf(spark, folder):
    return st.acf(series(spark, folder), SEG)


@query(
    "pacf",
    f"""{GREC}{acf_cte('g')}{PACF_CTE} SELECT segment, CAST(lag AS BIGINT) AS lag, {rs('pacf', 'band=1.96 / sqrt(n)')},
        lag > 0 AND ABS(pacf) > 1.96 / sqrt(n) AS is_significant FROM pf JOIN pa USING (segment)""",
)
def pacf(spark, folder):
    return st.pacf(series(spark, folder), SEG)


@query(
    "acf_interpretation",
    f"""{GREC}{acf_cte('g')}{PACF_CTE},
        p1 AS (SELECT segment, pacf AS p FROM pf WHERE lag = 1),
        sg AS (SELECT segment, COALESCE(array_to_string(list_slice(list(lag ORDER BY lag) FILTER (lag > 0 AND ABS(acf) > band), 1, 10), ','), '')
                      AS significant_lags FROM ac GROUP BY 1)
        SELECT segment, CASE WHEN ABS(rr[13]) > 0.5 THEN 'slow' ELSE 'fast' END AS decay_rate, significant_lags,
          CASE WHEN ABS(rr[13]) > 0.5 THEN 'Strong annual seasonality detected (ACF at lag 12)'
               WHEN ABS(rr[7]) > 0.5 THEN 'Moderate semi-annual pattern detected' END AS seasonality,
          CASE WHEN len(list_filter(rr[2:13], lambda v: ABS(v) >= 0.3)) = 0 THEN 'Short memory - recent values have little influence on future'
               WHEN ABS(rr[2]) > 0.8 THEN 'Long memory - high persistence in the series' END AS memory,
          CASE WHEN p > 0.8 THEN 'Strong AR(1) component suggested' WHEN p > 0.5 THEN 'Moderate AR(1) component suggested' END AS ar_order
        FROM pa JOIN p1 USING (segment) JOIN sg USING (segment)""",
)
def acf_interpretation(spark, folder):
    return st.acf_interpretation(series(spark, folder), SEG)


DIFF_CTE = """,
dg0 AS (SELECT segment, i, y - LAG(y) OVER (PARTITION BY segment ORDER BY date) AS y FROM g),
dg AS (SELECT * FROM dg0 WHERE y IS NOT NULL)
"""


@query(
    "differenced_acf",
    f"""{GREC}{DIFF_CTE}{acf_cte('dg')}{PACF_CTE} SELECT ac.segment, ac.lag, {rs('acf', 'pacf', 'band')}
        FROM ac JOIN pf ON pf.segment = ac.segment AND pf.lag = ac.lag""",
)
def differenced_acf(spark, folder):
    return st.differenced_acf(series(spark, folder), SEG)


KPSS_CTE = """,
ke AS (SELECT segment, i, len, y - AVG(y) OVER (PARTITION BY segment) AS e FROM g),
kc AS (SELECT *, SUM(e) OVER (PARTITION BY segment ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM ke),
k0 AS (SELECT segment, CAST(MAX(len) AS DOUBLE) AS n, SUM(c * c) AS eta, SUM(e * e) AS s0 FROM kc GROUP BY 1),
kd AS (SELECT a.segment, a.i - b.i AS lag, SUM(a.e * b.e) AS s FROM ke a JOIN ke b ON b.segment = a.segment AND b.i < a.i GROUP BY 1, 2),
k1 AS (SELECT k0.segment, MAX(n) AS n, MAX(s0) / MAX(n) + SUM(s / (n / 2)) AS a0, SUM(lag * s / (n / 2)) AS a1
       FROM k0 JOIN kd ON kd.segment = k0.segment AND lag <= floor(pow(n, 2e0 / 9)) GROUP BY 1),
k2 AS (SELECT segment, CAST(LEAST(floor(1.1447 * pow(pow(a1 / a0, 2), 1e0 / 3) * pow(n, 1e0 / 3)), n - 1) AS BIGINT) AS lags FROM k1),
k3 AS (SELECT k0.segment, CAST(MAX(n) AS BIGINT) AS n, MAX(lags) AS lags_used,
              (MAX(eta) / (MAX(n) * MAX(n))) / ((MAX(s0) + COALESCE(SUM(2 * s * (1 - lag / (lags + 1e0))), 0)) / MAX(n)) AS kpss_stat
       FROM k0 JOIN k2 USING (segment) LEFT JOIN kd ON kd.segment = k0.segment AND lag <= lags GROUP BY 1),
k4 AS (SELECT *, CASE WHEN kpss_stat <= 0.347 THEN 0.10 WHEN kpss_stat <= 0.463 THEN 0.10 - 0.05 * (kpss_stat - 0.347) / (0.463 - 0.347)
                      WHEN kpss_stat <= 0.574 THEN 0.05 - 0.025 * (kpss_stat - 0.463) / (0.574 - 0.463)
                      WHEN kpss_stat <= 0.739 THEN 0.025 - 0.015 * (kpss_stat - 0.574) / (0.739 - 0.574) ELSE 0.01 END AS p_value FROM k3)
"""


@query(
    "kpss_test",
    f"""{G}{KPSS_CTE} SELECT segment, n, {rs('kpss_stat', 'p_value')}, lags_used, p_value > 0.05 AS is_stationary,
        CASE WHEN p_value > 0.05 THEN 'Stationary' ELSE 'Non-stationary' END AS conclusion FROM k4""",
)
def kpss_test(spark, folder):
    return st.kpss_test(series(spark, folder), SEG)


@query("adf_test")
def adf_test(spark, folder):
    return st.adf_test(series(spark, folder), SEG)


@query("stationarity_verdict")
def stationarity_verdict(spark, folder):
    return st.stationarity_verdict(series(spark, folder), SEG)
