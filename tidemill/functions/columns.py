"""Small Column helpers shared by all operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null (also under ANSI mode)."""
    return F.try_divide(a, b)


def pct(a: Column, b: Column) -> Column:
    """Growth of a over b in percent."""
    return div(a - b, b) * F.lit(100.0)


def dbl(value: float) -> Column:
    return F.lit(float(value))


def stable_round(x: Column, digits: int = 6) -> Column:
    """Round for display with the tie point moved off the decimal grid.

    Averages of money amounts end in exact halves often enough for the last
    bit of a double to decide the rounding. Shifting the tie by a small
    irrational part makes the result depend on the value only.
    """
    scale = float(10**digits)
    moved = x * dbl(scale) + dbl(0.50003141)
    # from 2^53 on a double is a whole number, and beyond the range of bigint floor would saturate
    whole = F.when(F.abs(moved) < dbl(2.0**53), F.floor(moved).cast("double")).otherwise(moved)
    return F.when(F.abs(x) < dbl(1e300 / scale), whole / dbl(scale)).otherwise(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ladder(x: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose threshold ``x`` exceeds; thresholds are given from high to low."""
    out = None
    for threshold, label in steps:
        cond = x > dbl(threshold)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner scheme; coefficients from the highest power down."""
    out = dbl(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + dbl(c)
    return out


def filled_frame(agg: Column, y: Column, frame: WindowSpec, width: int) -> Column:
    """Aggregate over a frame, null unless the frame holds ``width`` non-null values."""
    return F.when(F.count(y).over(frame) == F.lit(width), agg.over(frame))


def month_label(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
