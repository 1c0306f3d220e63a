"""Parts of reports: several statistics of a series from one sorted pass and one grouped aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut_lineage
from tidemill.spec import SeriesSpec


def with_index(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Adds row index ``i`` from 0, ``age`` from 1 (newest) and series length ``n``.

    The age follows from index and length, which saves a sort in the other direction.
    """
    out = df.withColumn("i", (F.row_number().over(spec.ordered()) - 1).cast("bigint"))
    out = out.withColumn("n", F.count(F.lit(1)).over(spec.whole()))
    return out.withColumn("age", F.col("n") - F.col("i"))


def written(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The series itself as a checkpoint: reports read it often, the facts behind it once."""
    return cut_lineage(df.select(*spec.ids, spec.value))


class Part(NamedTuple):
    """One statistic: columns of the indexed rows, aggregates of a series, and results made of these.

    ``rows`` adds columns under names no other part uses; ``finish`` selects ``spec.keys`` and its results.
    """

    aggs: Callable[[SeriesSpec], list[Column]]
    rows: Callable[[DataFrame, SeriesSpec], DataFrame] = lambda rows, spec: rows
    finish: Callable[[DataFrame, SeriesSpec], DataFrame] = lambda table, spec: table


def alone(df: DataFrame, spec: SeriesSpec, part: Part) -> DataFrame:
    """The results of one part: keys and its columns."""
    rows = part.rows(with_index(df, spec), spec)
    return part.finish(rows.groupBy(*spec.keys).agg(*part.aggs(spec)), spec)


def together(df: DataFrame, spec: SeriesSpec, parts: dict[str, Part]) -> DataFrame:
    """Keys and one structure per part, from one exchange, one sort in time and one aggregate."""
    rows = with_index(df, spec)
    for part in parts.values():
        rows = part.rows(rows, spec)
    table = rows.groupBy(*spec.keys).agg(*[F.struct(*part.aggs(spec)).alias(name) for name, part in parts.items()])
    carrying = replace(spec, keys=(*spec.keys, "_rest"))
    for name, part in parts.items():
        others = [c for c in table.columns if c != name and c not in spec.keys]
        # the other parts travel as if they were a key, so that any part can be finished in place
        rest = F.struct(*others, F.lit(0).alias("_none")).alias("_rest")
        done = part.finish(table.select(*spec.keys, rest, f"{name}.*"), carrying)
        results = [c for c in done.columns if c not in carrying.keys]
        table = done.select(*spec.keys, *[F.col(f"_rest.{c}").alias(c) for c in others], F.struct(*results).alias(name))
    return table
