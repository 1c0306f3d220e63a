"""What a series is: its keys, time column, value column, calendar step and season length."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

FREQUENCIES = ("month", "day", "hour")


@dataclass(frozen=True)
class SeriesSpec:
    """Describes a table of regular series, one row per (keys, time).

    After a roll-up one series is at most as long as its calendar, so a window
    partitioned by ``keys`` is bounded however many facts lie behind it.
    """

    keys: tuple[str, ...] = ("series",)
    time: str = "date"
    value: str = "y"
    freq: str = "month"
    period: int = 12

    def __post_init__(self):
        if not self.keys:
            raise ValueError("a series needs at least one key column; roll-ups add 'series' when none is given")
        if self.freq not in FREQUENCIES:
            raise ValueError(f"unknown frequency {self.freq!r}, expected one of {FREQUENCIES}")

    def with_value(self, value: str) -> SeriesSpec:
        return replace(self, value=value)

    def with_keys(self, *keys: str) -> SeriesSpec:
        return replace(self, keys=tuple(keys))

    @property
    def y(self) -> Column:
        return F.col(self.value)

    @property
    def t(self) -> Column:
        return F.col(self.time)

    @property
    def ids(self) -> list[str]:
        return [*self.keys, self.time]

    def whole(self) -> WindowSpec:
        """All rows of a series, unordered."""
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        """A series in time order."""
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def reversed(self) -> WindowSpec:
        """A series from newest to oldest.

        Used instead of frames that end at UNBOUNDED FOLLOWING, which Spark
        re-evaluates from scratch for every row.
        """
        return Window.partitionBy(*self.keys).orderBy(F.col(self.time).desc())

    def truncate(self, ts: Column) -> Column:
        if self.freq == "month":
            return F.trunc(ts, "MM")
        if self.freq == "day":
            return F.to_date(ts)
        return F.date_trunc("hour", ts)

    def shift(self, t: Column, n: int | Column) -> Column:
        """``t`` moved by ``n`` calendar steps."""
        n = F.lit(n) if isinstance(n, int) else n
        if self.freq == "month":
            return F.add_months(t, n)
        if self.freq == "day":
            return F.date_add(t, n)
        return F.timestamp_add("HOUR", n, t)

    def steps_between(self, start: Column, stop: Column) -> Column:
        """Whole calendar steps from ``start`` to ``stop``."""
        if self.freq == "month":
            return (F.year(stop) - F.year(start)) * 12 + F.month(stop) - F.month(start)
        if self.freq == "day":
            return F.date_diff(stop, start)
        return F.timestamp_diff("HOUR", start, stop)

    def calendar(self, start: Column, stop: Column) -> Column:
        """Array of every calendar step from ``start`` to ``stop``, both included."""
        step = {"month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR"}[self.freq]
        return F.sequence(start, stop, F.expr(step))
