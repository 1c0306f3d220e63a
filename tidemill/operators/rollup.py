"""Facts to series: the only operators that touch raw fact rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, require
from tidemill.spec import SeriesSpec


def exact_sum(column: Column, scale: int | None = None, precision: int = 18) -> Column:
    """Sum in doubles, or, with a ``scale``, the order-independent sum of decimals of that many digits after the point.

    A value that ``precision`` digits cannot hold fails the job; decimals up to 38 digits may be asked for.
    """
    return F.sum(column.cast("double") if scale is None else column.cast(f"decimal({precision},{scale})"))


def monthly_rollup(
    facts: DataFrame,
    spec: SeriesSpec,
    ts: str,
    measures: Mapping[str, str],
    count: str | None = "n",
    unit: float = 1.0,
    scale: int | None = None,
) -> DataFrame:
    """Sum measures per (keys, calendar step); one map-side combined hash aggregate.

    ``measures`` maps output names to fact columns; sums are divided by ``unit``.
    A hot key shrinks to one row per step in every map task before the shuffle.
    """
    if spec.keys == ("series",) and "series" not in facts.columns:
        facts = facts.withColumn("series", F.lit("ALL"))
    require(facts, *spec.keys, ts, *measures.values())
    aggs = [exact_sum(F.col(src), scale).alias(out) for out, src in measures.items()]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    steps = facts.where(F.col(ts).isNotNull()).withColumn(spec.time, spec.truncate(F.col(ts)))
    rolled = steps.groupBy(*spec.ids).agg(*aggs)
    return rolled.select(
        *spec.ids,
        *[(F.col(m).cast("double") / dbl(unit)).alias(m) for m in measures],
        *([count] if count else []),
    )


def rollup_by_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    on: tuple[str, str],
    keys: Sequence[str],
    spec: SeriesSpec,
    ts: str,
    measures: Mapping[str, str],
    count: str | None = "n",
    unit: float = 1.0,
    scale: int | None = None,
) -> DataFrame:
    """Roll up facts by attributes of a dimension.

    Facts are first combined per (join key, step), so the join sees at most one
    row per join key and step: a join key holding a third of all facts costs no
    more than any other. The join strategy is left to adaptive execution, which
    broadcasts the dimension only when its measured size allows it.
    """
    fact_key, dim_key = on
    require(facts, fact_key, ts, *measures.values())
    require(dimension, dim_key, *keys)
    aggs = [exact_sum(F.col(src), scale).alias(out) for out, src in measures.items()]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    pre = (
        facts.where(F.col(ts).isNotNull())
        .withColumn(spec.time, spec.truncate(F.col(ts)))
        .groupBy(fact_key, spec.time)
        .agg(*aggs)
    )
    dim = dimension.select(F.col(dim_key).alias(fact_key), *keys)
    sums = [F.sum(m).alias(m) for m in measures]
    if count:
        sums.append(F.sum(count).alias(count))
    rolled = pre.join(dim, fact_key).groupBy(*keys, spec.time).agg(*sums)
    return rolled.select(
        *keys,
        spec.time,
        *[(F.col(m).cast("double") / dbl(unit)).alias(m) for m in measures],
        *([count] if count else []),
    )


def rollup_losses(facts: DataFrame, ts: str, dimension: DataFrame | None = None, on: tuple[str, str] | None = None) -> DataFrame:
    """One row: facts in all, without a timestamp, and dated but without a row of the dimension.

    The last two are the facts a roll-up leaves out. Facts are combined per join key before the join.
    """
    if dimension is None or on is None:
        return facts.agg(
            F.count(F.lit(1)).alias("facts"), F.count_if(F.col(ts).isNull()).alias("undated"), F.lit(0).cast("bigint").alias("unmatched")
        )
    fact_key, dim_key = on
    per_key = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.count(F.col(ts)).alias("_dated"))
    known = dimension.select(F.col(dim_key).alias("_k"), F.lit(True).alias("_known")).where(F.col("_k").isNotNull()).distinct()
    counted = per_key.join(known, "_k", "left")
    zero = F.lit(0).cast("bigint")
    return counted.agg(
        F.coalesce(F.sum("_n"), zero).alias("facts"),
        F.coalesce(F.sum(F.col("_n") - F.col("_dated")), zero).alias("undated"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_dated"))), zero).alias("unmatched"),
    )


def drop_partial_last(series: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Series without its newest step, which is often still filling up."""
    newest = F.max(spec.time).over(spec.whole())
    return series.withColumn("_newest", newest).where(spec.t < F.col("_newest")).drop("_newest")
