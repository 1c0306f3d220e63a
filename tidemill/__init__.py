"""Tidemill: keyed calendar time series on Spark DataFrames."""

from tidemill.spec import SeriesSpec

__all__ = ["SeriesSpec"]
