"""Feature families on the segment grid, and whole feature tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs

SEG = tb.SEGMENT
G = f"WITH {tb.SEGMENT_GRID_SQL}"
W = "(PARTITION BY segment ORDER BY date)"


def series(spark, folder):
    return tb.segment_grid(spark, folder).drop("n")


def lag(k: int) -> str:
    return f"LAG(y, {k}) OVER {W}" if k else "y"


def growth(k: int, shift: int = 0) -> str:
    return f"({lag(shift)} / NULLIF({lag(shift + k)}, 0) - 1)"


def framed(fn: str, w: int, current: bool = False) -> str:
    rows = f"{w - 1} PRECEDING AND CURRENT ROW" if current else f"{w} PRECEDING AND 1 PRECEDING"
    over = f"OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN {rows})"
    return f"CASE WHEN COUNT(y) {over} = {w} THEN {fn} {over} END"


TWO_PI = repr(2.0 * math.pi)

LAG_SQL = {f"lag_{k}": lag(k) for k in (1, 3, 6, 12)}
ROLLING_SQL = {
    f"rolling_{name}_{w}": framed(fn, w)
    for w in (3, 6, 12)
    for name, fn in (
        ("mean", "AVG(y)"), ("std", "STDDEV_SAMP(y)"), ("min", "MIN(y)"), ("max", "MAX(y)"),
        ("median", "quantile_cont(y, 0.5)"),
    )
}
MOM_SQL = {"mom_growth": growth(1), "mom_growth_lag1": growth(1, 1), "mom_growth_lag3": growth(1, 3)}
YOY_SQL = {"yoy_growth": growth(12), "yoy_growth_lag1": growth(12, 1)}
ACCEL_SQL = {
    "mom_acceleration": f"{growth(1)} - {growth(1, 1)}",
    "mom_acceleration_lag1": f"{growth(1, 1)} - {growth(1, 2)}",
}
CUM_SQL = {"cumulative_growth": f"y / FIRST_VALUE(y) OVER {W} - 1"}
PARTS_SQL = {
    "month": "month(date)", "quarter": "quarter(date)", "year": "year(date)",
    "month_of_year": "month(date)", "quarter_of_year": "quarter(date)",
}
CYCLE_SQL = {
    "month_sin": f"sin({TWO_PI} * month(date) / 12)", "month_cos": f"cos({TWO_PI} * month(date) / 12)",
    "quarter_sin": f"sin({TWO_PI} * quarter(date) / 4)", "quarter_cos": f"cos({TWO_PI} * quarter(date) / 4)",
}
SINCE_SQL = {
    "years_since_start": "year(date) - MIN(year(date)) OVER (PARTITION BY segment) + (month(date) - 1) / 12e0"
}
FOURIER_SQL = {
    f"fourier_{fn}_{k}": f"{fn}({2.0 * math.pi * k!r} * month(date) / 12)" for k in (1, 2, 3) for fn in ("sin", "cos")
}
EVENT_SQL = {
    "is_festive": "CAST(month(date) IN (10, 11, 12) AS BIGINT)",
    "is_q4": "CAST(quarter(date) = 4 AS BIGINT)",
    "is_jan": "CAST(month(date) = 1 AS BIGINT)",
    "is_lockdown": "CAST(date BETWEEN DATE '2020-03-01' AND DATE '2021-03-01' AS BIGINT)",
    "days_to_festive": "CAST(GREATEST(0, (10 - month(date)) * 30) AS BIGINT)",
}
DIFF_SQL = {
    "volume_diff": f"y - {lag(1)}", "volume_diff_lag1": f"{lag(1)} - {lag(2)}", "volume_diff_lag3": f"{lag(3)} - {lag(4)}",
}
VOL_SQL = {
    f"volatility_{w}m": f"({framed('STDDEV_SAMP(y)', w, True)}) / NULLIF({framed('AVG(y)', w, True)}, 0)" for w in (3, 6, 12)
}
MOMENTUM_SQL = {f"price_momentum_{k}": f"y - {lag(k)}" for k in (3, 6)}
MEAN = {w: f"({framed('AVG(y)', w)})" for w in (3, 6, 12)}
RATIO_SQL = {
    "volume_ratio_3_12": f"{MEAN[3]} / NULLIF({MEAN[12]}, 0)", "volume_ratio_6_12": f"{MEAN[6]} / NULLIF({MEAN[12]}, 0)",
    "trend_strength": f"({MEAN[3]} - {MEAN[12]}) / NULLIF({MEAN[12]}, 0)",
    "seasonal_ratio": f"{lag(1)} / NULLIF({lag(12)}, 0)",
}
INTERACTION_SQL = {"festive_growth_boost": f"{growth(1)} * CAST(month(date) IN (10, 11, 12) AS INT)"}
TREND_SQL = {"trend": "i", "trend_squared": "i * i"}
WHOLE = {*PARTS_SQL, *EVENT_SQL, *TREND_SQL}


def columns_sql(*groups: dict[str, str], names: list[str] | None = None) -> str:
    merged: dict[str, str] = {}
    for g in groups:
        merged.update(g)
    names = names or list(merged)
    return ", ".join(f"{merged[n]} AS {n}" if n in WHOLE else r(merged[n], n) for n in names)


def family(name: str, build, *groups: dict[str, str]) -> None:
    """Registers one feature family: key, date, value and the family's columns."""

    @query(name, f"{G} SELECT segment, date, {rs('y')}, {columns_sql(*groups)} FROM g")
    def run(spark, folder):
        return ft.with_features(series(spark, folder), SEG, build)


family("lag_features", ft.lag_features, LAG_SQL)
family("rolling_stats", ft.rolling_stats, ROLLING_SQL)
family(
    "rolling_current", ft.rolling_current,
    {f"{a}_{w}m": framed(fn, w, True) for w in (3, 6, 12) for a, fn in (("mean", "AVG(y)"), ("std", "STDDEV_SAMP(y)"))},
)
family("growth_mom", ft.growth_mom, MOM_SQL)
family("growth_yoy", ft.growth_yoy, YOY_SQL)
family("growth_acceleration", ft.growth_acceleration, ACCEL_SQL)
family("cumulative_growth", ft.cumulative_growth, CUM_SQL)
family("calendar_parts", ft.calendar_parts, PARTS_SQL)
family("cyclic_encoding", ft.cyclic_encoding, CYCLE_SQL)
family("years_since_start", ft.years_since_start, SINCE_SQL)
family("trend_index", ft.trend_index, TREND_SQL)
family("fourier_terms", ft.fourier_terms, FOURIER_SQL)
family("event_flags", ft.event_flags, EVENT_SQL)
family("diff_features", ft.diff_features, DIFF_SQL)
family("volatility", ft.volatility, VOL_SQL)
family("momentum", ft.momentum, MOMENTUM_SQL)
family("ratio_features", ft.ratio_features, RATIO_SQL)
family("interaction_features", ft.interaction_features, INTERACTION_SQL)

# exponential means by recursion over the row index
EMA_CTE = """,
ema AS (
  SELECT segment, i, y, CAST(NULL AS DOUBLE) AS e3, CAST(NULL AS DOUBLE) AS e6, CAST(NULL AS DOUBLE) AS e12
  FROM g WHERE i = 0
  UNION ALL
  SELECT g.segment, g.i, g.y,
         CASE WHEN p.i = 0 THEN p.y ELSE (2e0/4) * p.y + (1 - 2e0/4) * p.e3 END,
         CASE WHEN p.i = 0 THEN p.y ELSE (2e0/7) * p.y + (1 - 2e0/7) * p.e6 END,
         CASE WHEN p.i = 0 THEN p.y ELSE (2e0/13) * p.y + (1 - 2e0/13) * p.e12 END
  FROM ema p JOIN g ON g.segment = p.segment AND g.i = p.i + 1)
"""
GE = f"WITH RECURSIVE {tb.SEGMENT_GRID_SQL}{EMA_CTE}"
EMA_SQL = {"ema_3": "e3", "ema_6": "e6", "ema_12": "e12"}


@query(
    "ewm_features",
    f"""{GE} SELECT g.segment, g.date, {r('g.y', 'y')}, {rs('ema_3=e3', 'ema_6=e6', 'ema_12=e12')}
        FROM g JOIN ema ON g.segment = ema.segment AND g.i = ema.i""",
)
def ewm_features(spark, folder):
    return ft.ewm_features(series(spark, folder), SEG)


DECOMP_CTE = """,
ma AS (
  SELECT *, CASE WHEN len >= 24 AND COUNT(y) OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
    THEN (SUM(y) OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
          + 0.5 * (LAG(y, 6) OVER (PARTITION BY segment ORDER BY date) + LEAD(y, 6) OVER (PARTITION BY segment ORDER BY date))) / 12 END
    AS decomp_trend FROM g),
"""
MULT_CTE = DECOMP_CTE + """
ph AS (SELECT segment, i % 12 AS p, AVG(y / decomp_trend) AS m FROM ma GROUP BY 1, 2),
ce AS (SELECT segment, AVG(m) AS c FROM ph GROUP BY 1),
dec AS (SELECT ma.*, m / c AS decomp_seasonal, y / (m / c) / decomp_trend AS decomp_resid
        FROM ma JOIN ph ON ma.segment = ph.segment AND ma.i % 12 = ph.p JOIN ce ON ce.segment = ma.segment)
"""
ADD_CTE = DECOMP_CTE + """
ph AS (SELECT segment, i % 12 AS p, AVG(y - decomp_trend) AS m FROM ma GROUP BY 1, 2),
ce AS (SELECT segment, AVG(m) AS c FROM ph GROUP BY 1),
dec AS (SELECT ma.*, m - c AS decomp_seasonal, y - (m - c) - decomp_trend AS decomp_resid
        FROM ma JOIN ph ON ma.segment = ph.segment AND ma.i % 12 = ph.p JOIN ce ON ce.segment = ma.segment)
"""
PARTS3 = rs("y", *ft.DECOMPOSED)


@query("decompose", f"{G}{MULT_CTE} SELECT segment, date, {PARTS3} FROM dec")
def decompose(spark, folder):
    return ft.decompose(series(spark, folder), SEG)


@query("decompose_additive", f"{G}{ADD_CTE} SELECT segment, date, {PARTS3} FROM dec")
def decompose_additive(spark, folder):
    return ft.decompose(series(spark, folder), SEG, "additive")


LAGGED3 = rs("y", *[f"{c}=LAG({c}) OVER {W}" for c in ft.DECOMPOSED])


@query("decompose_lagged", f"{G}{MULT_CTE} SELECT segment, date, {LAGGED3} FROM dec")
def decompose_lagged(spark, folder):
    return ft.decompose_lagged(series(spark, folder), SEG)


@query(
    "trend_direction",
    f"""{G}{MULT_CTE},
        td AS (SELECT segment, AVG(decomp_trend) FILTER (i >= len - 12) AS a,
                      AVG(decomp_trend) FILTER (i >= len - 24 AND i < len - 12) AS b FROM dec GROUP BY 1)
        SELECT segment, {rs('recent_trend=a', 'earlier_trend=b')},
               CASE WHEN a > b THEN 'increasing' ELSE 'decreasing' END AS trend_direction FROM td""",
)
def trend_direction(spark, folder):
    return ft.trend_direction(series(spark, folder), SEG)


FULL_GROUPS = (
    LAG_SQL, ROLLING_SQL, EMA_SQL, MOM_SQL, YOY_SQL, {"mom_acceleration": ACCEL_SQL["mom_acceleration"]}, CUM_SQL,
    PARTS_SQL, CYCLE_SQL, SINCE_SQL, FOURIER_SQL, EVENT_SQL, DIFF_SQL, VOL_SQL, MOMENTUM_SQL,
)


@query(
    "create_features",
    f"""{GE}{MULT_CTE}, full_table AS (SELECT dec.*, e3, e6, e12 FROM dec JOIN ema USING (segment, i, y))
        SELECT segment, date, {LAGGED3}, {columns_sql(*FULL_GROUPS)} FROM full_table""",
)
def create_features(spark, folder):
    return ft.create_features(series(spark, folder), SEG, "full")


@query(
    "create_features_service",
    f"""{G} SELECT segment, date, {rs('y')}, {columns_sql(
        LAG_SQL, {k: v for k, v in ROLLING_SQL.items() if 'median' not in k},
        {k: MOM_SQL[k] for k in ('mom_growth', 'mom_growth_lag1')}, YOY_SQL, TREND_SQL, CYCLE_SQL,
        {k: EVENT_SQL[k] for k in ('is_festive', 'is_q4')}, {k: DIFF_SQL[k] for k in ('volume_diff', 'volume_diff_lag1')})}
        FROM g QUALIFY i >= 13""",
)
def create_features_service(spark, folder):
    return ft.create_features(series(spark, folder), SEG, "service", nulls="drop")


@query(
    "create_features_extended",
    f"""{G} SELECT segment, date, {rs('y')}, {columns_sql(
        LAG_SQL, ROLLING_SQL, MOM_SQL, YOY_SQL, ACCEL_SQL, PARTS_SQL, CYCLE_SQL, SINCE_SQL,
        {k: EVENT_SQL[k] for k in ('is_festive', 'is_q4', 'is_jan')}, DIFF_SQL, VOL_SQL, RATIO_SQL, INTERACTION_SQL)}
        FROM g QUALIFY i >= 13""",
)
def create_features_extended(spark, folder):
    return ft.create_features(series(spark, folder), SEG, "extended", nulls="drop")


@query(
    "features_as_json",
    f"""{G} SELECT segment, date, '{{"month":' || month(date) || ',"quarter":' || quarter(date) || ',"is_festive":'
        || CAST(month(date) IN (10, 11, 12) AS INT) || ',"trend":' || i || '}}' AS features FROM g""",
)
def features_as_json(spark, folder):
    base = ft.with_features(series(spark, folder), SEG, ft.calendar_parts, ft.event_flags, ft.trend_index)
    return ft.features_as_json(base, SEG, ["month", "quarter", "is_festive", "trend"])


@query(
    "sequences",
    f"""{G}, s AS (SELECT segment, date, y AS target, {', '.join(f'LAG(y, {7 - k}) OVER {W} AS s{k}' for k in range(1, 7))}, i FROM g)
        SELECT segment, date, {rs('target', *[f's{k}' for k in range(1, 7)])} FROM s WHERE i >= 6""",
)
def sequences(spark, folder):
    rows = ft.sequences(series(spark, folder), SEG, 6)
    return rows.select("segment", "date", "target", *[F.col("sequence")[k - 1].alias(f"s{k}") for k in range(1, 7)])


@query(
    "growth_series",
    f"""{G} SELECT segment, date, {rs('y', f'growth=COALESCE({growth(1)}, 0)', f'diff=COALESCE(y - {lag(1)}, 0)')} FROM g""",
)
def growth_series(spark, folder):
    return ft.growth_series(series(spark, folder), SEG)
