"""Blocked operators on long series against the window versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, features, stattests
from tidemill.spec import SeriesSpec

DAY = SeriesSpec(keys=("key",), freq="day", period=7)


@pytest.fixture(scope="module")
def long_series(spark):
    """10,000 days with gaps in the calendar and missing values, a short series, one of a null key, one without values."""
    rng = random.Random(2)
    rows = []
    for i in range(10_000):
        if rng.random() < 0.97:
            y = None if rng.random() < 0.03 or 3000 < i < 3700 else 50 + 9 * math.sin(i / 40) + 3 * math.sin(2 * math.pi * i / 7) + rng.gauss(0, 1)
            rows.append(("a", i, y))
    rows += [("b", i, float(i * i % 17 + 1)) for i in range(9)] + [(None, i, float(i % 5 + 2)) for i in range(600)] + [("none", i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, day int, y double")
    return df.select("key", F.date_add(F.lit("1990-01-01").cast("date"), F.col("day")).alias("date"), "y").repartition(6)


def table(df, *names):
    return {(r.key, r.date): [r[n] for n in names] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), k


def test_places_count_rows_whatever_the_gaps(spark, long_series):
    want = F.row_number().over(DAY.ordered()) - 1
    rows = blocks.with_places(long_series.withColumn("_w", want), DAY, 128).collect()
    sizes = {r.key: 0 for r in rows}
    for r in rows:
        sizes[r.key] += 1
        assert r._i == r._w
    assert all(r._n == sizes[r.key] for r in rows)


@pytest.mark.parametrize("size", [64, 700, 100_000])
def test_lags_and_rolling_statistics(long_series, size):
    names = [f"lag_{k}" for k in features.LAGS]
    same(
        table(blocks.lag_features(long_series, DAY, size=size), *names),
        table(features.with_features(long_series, DAY, features.lag_features), *names),
    )
    names = [f"rolling_{s}_{w}" for s in ("mean", "std", "min", "max", "median") for w in features.WINDOWS]
    same(
        table(blocks.rolling_stats(long_series, DAY, size=size), *names),
        table(features.with_features(long_series, DAY, features.rolling_stats), *names),
    )


def test_frames_longer_than_a_block(long_series):
    wide = lambda s: features.rolling_stats(s, (90,), median=False)
    names = ["rolling_mean_90", "rolling_max_90"]
    same(
        table(blocks.rolling_stats(long_series, DAY, (90,), False, size=32), *names),
        table(features.with_features(long_series, DAY, wide), *names),
    )


@pytest.mark.parametrize("size", [50, 300, 100_000])
def test_exponential_means_carry_over_blocks(long_series, size):
    spans = (3, 12, 200)
    names = [f"ema_{s}" for s in spans]
    same(
        table(blocks.ewm_features(long_series, DAY, spans, size=size), *names),
        table(features.ewm_features(long_series, DAY, spans), *names),
    )


@pytest.mark.parametrize("name", ["acf", "pacf"])
def test_autocorrelation(long_series, name):
    rows = lambda df: {(r.key, r.lag): (r[name], r.is_significant) for r in df.collect()}
    got = rows(getattr(blocks, name)(long_series, DAY, 30, size=200))
    want = rows(getattr(stattests, name)(long_series, DAY, 30))
    assert got.keys() == want.keys()
    for k, (value, flag) in want.items():
        assert got[k][1] == flag and (value is None or got[k][0] == pytest.approx(value, abs=1e-10))


@pytest.mark.parametrize(("model", "period"), [("multiplicative", 7), ("additive", 12)])
def test_decomposition(long_series, model, period):
    spec = SeriesSpec(keys=("key",), freq="day", period=period)
    same(
        table(blocks.decompose(long_series, spec, model, size=150), *features.DECOMPOSED),
        table(features.decompose(long_series, spec, model), *features.DECOMPOSED),
    )


def test_one_series_runs_in_many_tasks(spark):
    one = spark.range(200_000).select(
        F.lit("a").alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("date"), F.sin(F.col("id") / 50.0).alias("y")
    )
    spec = SeriesSpec(keys=("key",), freq="hour", period=24)
    # as for a series that is too large to be broadcast
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = {
            "rolling_mean_3": blocks.rolling_stats(one, spec, median=False, size=5000),
            "ema_3": blocks.ewm_features(one, spec, size=5000),
            "decomp_resid": blocks.decompose(one, spec, size=5000),
        }
        for name, out in made.items():
            tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("rows"), F.sum(name)).collect()
            sizes = [r["rows"] for r in tasks]
            assert len(sizes) >= 8 and max(sizes) <= 50_000 and sum(sizes) == 200_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_empty_series(spark):
    none = spark.createDataFrame([], "key string, date date, y double")
    for out in (blocks.lag_features(none, DAY), blocks.ewm_features(none, DAY), blocks.acf(none, DAY), blocks.decompose(none, DAY)):
        assert out.collect() == []
