"""Operators on blocks of a series, held to the SQL of the versions by whole series."""

from __future__ import annotations

from tidemill.operators import blocks
from tidemill.plans import describe_queries, feature_queries  # noqa: F401 - their SQL
from tidemill.plans import tables as tb
from tidemill.plans.registry import ORACLE, query

SIZE = 16  # steps: the monthly series of these tables have five blocks each


def series(spark, folder):
    return tb.segment_grid(spark, folder).drop("n")


def twin(name: str):
    @query(f"blocked_{name}", ORACLE[name])
    def run(spark, folder):
        return getattr(blocks, name)(series(spark, folder), tb.SEGMENT, size=SIZE)


for operator in ("lag_features", "rolling_stats", "ewm_features", "decompose", "acf", "pacf"):
    twin(operator)
