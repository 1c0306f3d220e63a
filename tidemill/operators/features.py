"""Feature columns, each family a function from a spec to named columns.

``with_features`` first stages the lags of the value as columns (one window, one
exchange, one sort) and hands the families a spec that reads those columns, so growth,
differences and momentum are plain arithmetic and no lag is computed twice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, filled_frame
from tidemill.spec import SeriesSpec

LAGS = (1, 3, 6, 12)
WINDOWS = (3, 6, 12)
SPANS = (3, 6, 12)
FESTIVE_MONTHS = (10, 11, 12)
LOCKDOWN = ("2020-03-01", "2021-03-01")

# Features that look at the current value of the target, or (centred trend) at later
# ones. Models leave them out by default.
DECOMPOSED = ("decomp_trend", "decomp_seasonal", "decomp_resid")
USES_CURRENT = (
    "mom_growth", "yoy_growth", "mom_acceleration", "cumulative_growth", "volume_diff",
    "volatility_3m", "volatility_6m", "volatility_12m", "price_momentum_3", "price_momentum_6",
    "festive_growth_boost", *DECOMPOSED,
)


Family = Callable[[SeriesSpec], dict[str, Column]]

REACH = 13


@dataclass(frozen=True)
class StagedSpec(SeriesSpec):
    """A spec whose lags up to ``reach`` exist as columns already."""

    reach: int = REACH

    def lag_column(self, k: int) -> Column:
        return self.y if k == 0 else F.col(f"_lag{k}")


def _lag(spec: SeriesSpec, k: int) -> Column:
    if isinstance(spec, StagedSpec) and k <= spec.reach:
        return spec.lag_column(k)
    return F.lag(spec.value, k).over(spec.ordered())


def with_features(df: DataFrame, spec: SeriesSpec, *families: Family, reach: int = REACH) -> DataFrame:
    """Adds the columns of the given families."""
    staged = StagedSpec(spec.keys, spec.time, spec.value, spec.freq, spec.period, reach)
    hidden = [f"_lag{k}" for k in range(1, reach + 1)]
    rows = df.withColumns({name: F.lag(spec.value, k).over(spec.ordered()) for k, name in enumerate(hidden, 1)})
    merged: dict[str, Column] = {}
    for family in families:
        merged.update(family(staged))
    return rows.withColumns(merged).drop(*hidden)


def _growth(spec: SeriesSpec, k: int, shift: int = 0) -> Column:
    """y / lag k - 1, ``shift`` rows ago."""
    now = _lag(spec, shift) if shift else spec.y
    return div(now, _lag(spec, shift + k)) - dbl(1.0)


def _rolling(spec: SeriesSpec, name: str, w: int, current: bool = False) -> Column:
    """One statistic over w values; null unless all of them are there.

    Sliding frames of the window operator beat folds over staged arrays here
    (measured: half the time), and all of them share its single sort.
    """
    frame = spec.ordered().rowsBetween(*((-(w - 1), 0) if current else (-w, -1)))
    stats = {
        "mean": F.avg(spec.value), "std": F.stddev_samp(spec.value), "min": F.min(spec.value), "max": F.max(spec.value),
        "median": F.percentile(spec.y, dbl(0.5)),
    }
    return filled_frame(stats[name], spec.y, frame, w)


def lag_features(spec: SeriesSpec, lags: Iterable[int] = LAGS) -> dict[str, Column]:
    return {f"lag_{k}": _lag(spec, k) for k in lags}


def rolling_stats(spec: SeriesSpec, windows: Iterable[int] = WINDOWS, median: bool = True) -> dict[str, Column]:
    """Statistics of the previous w values, the current one excluded."""
    names = ["mean", "std", "min", "max"] + (["median"] if median else [])
    return {f"rolling_{name}_{w}": _rolling(spec, name, w) for w in windows for name in names}


def rolling_current(spec: SeriesSpec, windows: Iterable[int] = WINDOWS) -> dict[str, Column]:
    """Rolling mean and sample std including the current value."""
    return {f"{name}_{w}m": _rolling(spec, name, w, True) for w in windows for name in ("mean", "std")}


# Weight of the value before the last block, below what a double can show beside 1.
EWM_LOST = 40.0  # exp(-40) = 4e-18
# Powers within a block stay below exp(600).
EWM_RANGE = 600.0


def _ewm_blocks(spans: Iterable[int]) -> list[tuple[int, list[int]]]:
    """Spans that can share a block of values, with its length: long enough for the slowest, in range for the fastest."""
    out: list[tuple[int, list[int]]] = []
    for s in sorted(set(spans)):
        rate = -math.log(1.0 - 2.0 / (s + 1)) if s > 1 else math.inf
        length = max(256, math.ceil(EWM_LOST / rate))
        fastest = -math.log(1.0 - 2.0 / (max(out[-1][1][0], 2) + 1)) if out else 0.0
        if out and length * fastest <= EWM_RANGE:
            out[-1] = (max(length, out[-1][0]), [*out[-1][1], s])
        else:
            out.append((length, [s]))
    return out


def ewm_features(df: DataFrame, spec: SeriesSpec, spans: Iterable[int] = SPANS) -> DataFrame:
    """Exponential means of the previous values, seeded with the first one; any span above 1.

    The recursion is unrolled into running sums: within a block of values,
    sum(x_s q^(t-s)) = q^t sum(x_s q^-s), and the value at the end of the block
    before carries over. Blocks are long enough for all older values to weigh less than a
    double can show. Constant work per row for series of any length.
    """
    spans = list(spans)
    if any(s <= 1 for s in spans):
        raise ValueError("spans must be above 1")
    w = spec.ordered()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before_now = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_place", F.when(spec.y.isNotNull(), F.count(spec.value).over(upto) - 1))
    for length, group in _ewm_blocks(spans):
        rows = rows.withColumn("_block", F.floor(F.col("_place") / F.lit(length)))
        rows = rows.withColumn("_j", (F.col("_place") % length).cast("double"))
        inside = Window.partitionBy(*spec.keys, "_block").orderBy(spec.time).rowsBetween(Window.unboundedPreceding, 0)
        local, carry, shifted = {}, {}, {}
        for s in group:
            alpha = 2.0 / (s + 1)
            q = dbl(1.0 - alpha)
            # the first value of all has full weight
            weighted = spec.y * F.when(F.col("_place") == 0, dbl(1.0)).otherwise(dbl(alpha)) * F.pow(q, -F.col("_j"))
            local[f"_local_{s}"] = F.pow(q, F.col("_j")) * F.sum(weighted).over(inside)
            ends = F.when(F.col("_j") == length - 1, F.col(f"_local_{s}"))
            before = F.last(ends, ignorenulls=True).over(before_now)
            carry[f"_ema_{s}"] = F.when(
                spec.y.isNotNull(), F.col(f"_local_{s}") + F.coalesce(F.pow(q, F.col("_j") + dbl(1.0)) * before, dbl(0.0))
            )
            shifted[f"ema_{s}"] = F.last(f"_ema_{s}", ignorenulls=True).over(before_now)
        rows = rows.withColumns(local).withColumns(carry).withColumns(shifted).drop("_block", "_j", *local, *carry)
    return rows.drop("_place")


def growth_mom(spec: SeriesSpec) -> dict[str, Column]:
    return {
        "mom_growth": _growth(spec, 1),
        "mom_growth_lag1": _growth(spec, 1, 1),
        "mom_growth_lag3": _growth(spec, 1, 3),
    }


def growth_yoy(spec: SeriesSpec) -> dict[str, Column]:
    return {"yoy_growth": _growth(spec, spec.period), "yoy_growth_lag1": _growth(spec, spec.period, 1)}


def growth_acceleration(spec: SeriesSpec) -> dict[str, Column]:
    return {
        "mom_acceleration": _growth(spec, 1) - _growth(spec, 1, 1),
        "mom_acceleration_lag1": _growth(spec, 1, 1) - _growth(spec, 1, 2),
    }


def cumulative_growth(spec: SeriesSpec) -> dict[str, Column]:
    first = F.first(spec.value).over(spec.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return {"cumulative_growth": div(spec.y, first) - dbl(1.0)}


def calendar_parts(spec: SeriesSpec) -> dict[str, Column]:
    month, quarter = F.month(spec.t), F.quarter(spec.t)
    return {
        "month": month,
        "quarter": quarter,
        "year": F.year(spec.t),
        "month_of_year": month,
        "quarter_of_year": quarter,
    }


def cyclic_encoding(spec: SeriesSpec) -> dict[str, Column]:
    m = dbl(2.0 * math.pi) * F.month(spec.t) / dbl(12.0)
    q = dbl(2.0 * math.pi) * F.quarter(spec.t) / dbl(4.0)
    return {"month_sin": F.sin(m), "month_cos": F.cos(m), "quarter_sin": F.sin(q), "quarter_cos": F.cos(q)}


def years_since_start(spec: SeriesSpec) -> dict[str, Column]:
    # rows come in time order, so the running minimum is the first year
    start = F.min(F.year(spec.t)).over(spec.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return {"years_since_start": (F.year(spec.t) - start) + (F.month(spec.t) - 1) / dbl(12.0)}


def trend_index(spec: SeriesSpec) -> dict[str, Column]:
    i = F.row_number().over(spec.ordered()) - 1
    return {"trend": i, "trend_squared": i * i}


def fourier_terms(spec: SeriesSpec, orders: Iterable[int] = (1, 2, 3), period: int = 12) -> dict[str, Column]:
    out = {}
    for k in orders:
        angle = dbl(2.0 * math.pi * k) * F.month(spec.t) / dbl(float(period))
        out[f"fourier_sin_{k}"] = F.sin(angle)
        out[f"fourier_cos_{k}"] = F.cos(angle)
    return out


def event_flags(spec: SeriesSpec, lockdown: tuple[str, str] = LOCKDOWN) -> dict[str, Column]:
    month = F.month(spec.t)
    start, end = (F.lit(d).cast("date") for d in lockdown)
    return {
        "is_festive": month.isin(*FESTIVE_MONTHS).cast("int"),
        "is_q4": (F.quarter(spec.t) == 4).cast("int"),
        "is_jan": (month == 1).cast("int"),
        "is_lockdown": spec.t.between(start, end).cast("int"),
        "days_to_festive": F.greatest(F.lit(0), (F.lit(10) - month) * 30),
    }


def diff_features(spec: SeriesSpec) -> dict[str, Column]:
    return {
        "volume_diff": spec.y - _lag(spec, 1),
        "volume_diff_lag1": _lag(spec, 1) - _lag(spec, 2),
        "volume_diff_lag3": _lag(spec, 3) - _lag(spec, 4),
    }


def volatility(spec: SeriesSpec, windows: Iterable[int] = WINDOWS) -> dict[str, Column]:
    return {f"volatility_{w}m": div(_rolling(spec, "std", w, True), _rolling(spec, "mean", w, True)) for w in windows}


def momentum(spec: SeriesSpec) -> dict[str, Column]:
    return {f"price_momentum_{k}": spec.y - _lag(spec, k) for k in (3, 6)}


def ratio_features(spec: SeriesSpec) -> dict[str, Column]:
    mean = {w: _rolling(spec, "mean", w) for w in WINDOWS}
    return {
        "volume_ratio_3_12": div(mean[3], mean[12]),
        "volume_ratio_6_12": div(mean[6], mean[12]),
        "trend_strength": div(mean[3] - mean[12], mean[12]),
        "seasonal_ratio": div(_lag(spec, 1), _lag(spec, 12)),
    }


def interaction_features(spec: SeriesSpec) -> dict[str, Column]:
    festive = F.month(spec.t).isin(*FESTIVE_MONTHS).cast("int")
    return {"festive_growth_boost": _growth(spec, 1) * festive}


# -- decomposition -----------------------------------------------------------


def decompose(df: DataFrame, spec: SeriesSpec, model: str = "multiplicative") -> DataFrame:
    """Classical decomposition: centred moving average, seasonal means by position, remainder.

    Series shorter than two seasons get nulls. All windows partition by the
    series keys (or the keys and the phase), so one exchange serves them all.
    """
    if model not in ("multiplicative", "additive"):
        raise ValueError(f"unknown model {model!r}")
    p, half = spec.period, spec.period // 2
    w = spec.ordered()
    y = spec.y
    if p % 2 == 0:
        frame = w.rowsBetween(-half, half)
        inner = F.sum(spec.value).over(w.rowsBetween(-(half - 1), half - 1))
        ends = dbl(0.5) * (F.lag(spec.value, half).over(w) + F.lead(spec.value, half).over(w))
        smooth = (inner + ends) / dbl(float(p))
    else:
        frame = w.rowsBetween(-half, half)
        smooth = F.avg(spec.value).over(frame)
    width = 2 * half + 1
    out = df.withColumns(
        {
            "_pos": F.row_number().over(w) - 1,
            "_n": F.count(F.lit(1)).over(spec.whole()),
            "decomp_trend": F.when(F.count(y).over(frame) == width, smooth),
        }
    )
    trend = F.when(F.col("_n") >= 2 * p, F.col("decomp_trend"))
    out = out.withColumn("decomp_trend", trend).withColumn("_phase", F.col("_pos") % p)
    t = F.col("decomp_trend")
    detrended = div(y, t) if model == "multiplicative" else y - t
    phase = Window.partitionBy(*spec.keys, "_phase")
    out = out.withColumn("_mean", F.avg(detrended).over(phase))
    centre = F.avg(F.when(F.col("_pos") < p, F.col("_mean"))).over(spec.whole())
    out = out.withColumn("_centre", centre)
    if model == "multiplicative":
        seasonal = div(F.col("_mean"), F.col("_centre"))
        resid = div(div(y, F.col("decomp_seasonal")), t)
    else:
        seasonal = F.col("_mean") - F.col("_centre")
        resid = y - F.col("decomp_seasonal") - t
    return (
        out.withColumn("decomp_seasonal", seasonal)
        .withColumn("decomp_resid", resid)
        .drop("_pos", "_n", "_phase", "_mean", "_centre")
    )


def decompose_lagged(df: DataFrame, spec: SeriesSpec, model: str = "multiplicative") -> DataFrame:
    """Decomposition parts of the previous step, as features."""
    parts = decompose(df, spec, model)
    return parts.withColumns({c: F.lag(c, 1).over(spec.ordered()) for c in DECOMPOSED})


def trend_direction(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean trend of the last season against the season before."""
    p = spec.period
    parts = decompose(df, spec).withColumn("_age", F.row_number().over(spec.reversed()))
    t, age = F.col("decomp_trend"), F.col("_age")
    recent = F.avg(F.when(age <= p, t))
    earlier = F.avg(F.when((age > p) & (age <= 2 * p), t))
    return parts.groupBy(*spec.keys).agg(
        recent.alias("recent_trend"),
        earlier.alias("earlier_trend"),
        F.when(recent > earlier, F.lit("increasing")).otherwise(F.lit("decreasing")).alias("trend_direction"),
    )


# -- whole feature tables ----------------------------------------------------


def _join(*groups: dict[str, Column]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for g in groups:
        out.update(g)
    return out


def _only(group: dict[str, Column], *names: str) -> dict[str, Column]:
    return {n: group[n] for n in names}


def feature_set(spec: SeriesSpec, variant: str = "full") -> dict[str, Column]:
    """Columns of one of the three published feature sets.

    ``full``: lags, rolling, growth, calendar, Fourier, events, momentum; exponential
    and decomposition columns are added by ``create_features``. ``service``: the
    smaller set with a trend index. ``extended``: volatility ratios and interactions
    instead of exponential and Fourier terms.
    """
    events = event_flags(spec)
    shared = _join(lag_features(spec), growth_yoy(spec), cyclic_encoding(spec))
    if variant == "service":
        return _join(
            shared, rolling_stats(spec, median=False), _only(growth_mom(spec), "mom_growth", "mom_growth_lag1"), trend_index(spec),
            _only(events, "is_festive", "is_q4"), _only(diff_features(spec), "volume_diff", "volume_diff_lag1"),
        )
    shared = _join(
        shared, rolling_stats(spec), growth_mom(spec), calendar_parts(spec), years_since_start(spec), diff_features(spec), volatility(spec)
    )
    if variant == "full":
        return _join(
            shared, _only(growth_acceleration(spec), "mom_acceleration"), cumulative_growth(spec), fourier_terms(spec), events, momentum(spec)
        )
    if variant == "extended":
        return _join(
            shared, growth_acceleration(spec), _only(events, "is_festive", "is_q4", "is_jan"), ratio_features(spec), interaction_features(spec)
        )
    raise ValueError(f"unknown feature set {variant!r}")


def feature_names(spec: SeriesSpec, variant: str = "full", leak_safe: bool = False) -> list[str]:
    names = list(feature_set(spec, variant))
    if variant == "full":
        names += [*[f"ema_{s}" for s in SPANS], *DECOMPOSED]
    return [n for n in names if not (leak_safe and n in USES_CURRENT)]


def create_features(df: DataFrame, spec: SeriesSpec, variant: str = "full", nulls: str = "keep") -> DataFrame:
    """Feature table of a complete series; ``nulls='drop'`` removes warm-up rows."""
    if nulls not in ("keep", "drop"):
        raise ValueError("nulls must be 'keep' or 'drop'")
    out = df.select(*spec.ids, spec.value)
    if variant == "full":
        out = ewm_features(decompose_lagged(out, spec), spec)
    out = with_features(out, spec, lambda staged: feature_set(staged, variant), reach=max(REACH, spec.period + 1))
    return out.dropna() if nulls == "drop" else out


def features_as_json(featured: DataFrame, spec: SeriesSpec, names: Sequence[str]) -> DataFrame:
    """Feature payload of each row as one JSON object."""
    return featured.select(*spec.ids, F.to_json(F.struct(*names)).alias("features"))


def sequences(df: DataFrame, spec: SeriesSpec, length: int = 6) -> DataFrame:
    """Sliding arrays of the previous ``length`` values with the value that follows."""
    past = F.collect_list(spec.value).over(spec.ordered().rowsBetween(-length, -1))
    out = df.withColumn("sequence", past).where(F.size("sequence") == length)
    return out.select(*spec.ids, "sequence", spec.y.alias("target"))


def growth_series(df: DataFrame, spec: SeriesSpec, second: str | None = None) -> DataFrame:
    """Value with relative and absolute change; the first row has zero change."""
    extra = [F.col(second)] if second else []
    return df.select(
        *spec.ids,
        spec.y,
        *extra,
        F.coalesce(_growth(spec, 1), dbl(0.0)).alias("growth"),
        F.coalesce(spec.y - _lag(spec, 1), dbl(0.0)).alias("diff"),
    )
