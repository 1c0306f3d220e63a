"""One long series in many tasks.

Window functions by key put a whole series into one task. Here its rows are numbered without such a window, cut into blocks of
``size`` rows, and each block also carries the rows before (and after) it that its frames reach. A block with its own key is then an
ordinary short series: every operator that looks back a bounded number of rows runs on it unchanged. What reaches
back without bound (running means, seasonal means) is a small table of one row per block, scanned per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div
from tidemill.operators import features, stattests
from tidemill.spec import SeriesSpec

SIZE = 100_000
HIDDEN = ("_key", "_i", "_n", "_stretch", "_own")


def _origin(spec: SeriesSpec) -> Column:
    return F.lit("1970-01-01").cast("timestamp" if spec.freq == "hour" else "date")


def with_places(df: DataFrame, spec: SeriesSpec, size: int = SIZE) -> DataFrame:
    """Adds ``_key``, all keys as one, ``_i``, the place of a row in its series from 0, and ``_n``, the rows of the series.

    Rows are ranged by their calendar step, ``size`` steps a range; a running sum over the counts of ranges (one row
    each) gives the first place of a range, a window inside the range the rest. Gaps in the calendar are fine; rows of one
    time are numbered in no fixed order, rows without a time are left out.
    """
    step = F.floor(spec.steps_between(_origin(spec), spec.t) / F.lit(size))
    # a struct is never null and equal where its parts are, null or not: joins keep null keys and the partitioning
    rows = df.withColumns({"_key": F.struct(*spec.keys), "_range": step})
    counts = rows.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "_key", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"), F.sum("_c").over(whole).alias("_n")
    )
    inside = Window.partitionBy("_key", "_range").orderBy(spec.time)
    placed = rows.withColumn("_in", F.row_number().over(inside) - 1).join(first, ["_key", "_range"])
    return placed.select(*df.columns, "_key", (F.col("_first") + F.col("_in")).alias("_i"), "_n")


def in_blocks(df: DataFrame, spec: SeriesSpec, back: int, ahead: int = 0, size: int = SIZE) -> tuple[DataFrame, SeriesSpec]:
    """Rows with ``_stretch``, each also in later blocks whose rows look ``back`` to it or earlier ones that look ``ahead``;
    ``_own`` marks the block it belongs to. The spec returned tells blocks apart."""
    rows = with_places(df, spec, size)
    i = F.col("_i")
    low = F.greatest(F.floor((i - F.lit(ahead)) / F.lit(size)), F.lit(0))
    high = F.least(F.floor((i + F.lit(back)) / F.lit(size)), F.floor((F.col("_n") - 1) / F.lit(size)))
    rows = rows.withColumn("_stretch", F.explode(F.sequence(low, high)))
    rows = rows.withColumn("_own", F.col("_stretch") == F.floor(i / F.lit(size)))
    return rows, spec.with_keys("_key", "_stretch")


def per_block(stats: DataFrame, size: int) -> DataFrame:
    """Values of a series (with its length ``_n``) once for every block, so that they join where the blocks are."""
    return stats.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.lit(size))))).drop("_n")


def joined(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` by key and block added to the rows."""
    keys = ["_key", "_stretch"]
    return blocks.join(values, keys).select(*blocks.columns, *(c for c in values.columns if c not in keys))


def own_rows(blocks: DataFrame) -> DataFrame:
    return blocks.where("_own").drop(*HIDDEN)


# -- look-back features ------------------------------------------------------


def with_features(df: DataFrame, spec: SeriesSpec, *families: features.Family, back: int, size: int = SIZE) -> DataFrame:
    """``features.with_features`` block by block. ``back``: how many rows the families look back, themselves included."""
    blocks, by_block = in_blocks(df, spec, back, size=size)
    return own_rows(features.with_features(blocks, by_block, *families, reach=min(back, features.REACH)))


def lag_features(df: DataFrame, spec: SeriesSpec, lags: Iterable[int] = features.LAGS, size: int = SIZE) -> DataFrame:
    lags = tuple(lags)
    return with_features(df, spec, lambda s: features.lag_features(s, lags), back=max(lags), size=size)


def rolling_stats(df: DataFrame, spec: SeriesSpec, windows: Iterable[int] = features.WINDOWS, median: bool = True, size: int = SIZE) -> DataFrame:
    windows = tuple(windows)
    return with_features(df, spec, lambda s: features.rolling_stats(s, windows, median), back=max(windows), size=size)


def ewm_features(df: DataFrame, spec: SeriesSpec, spans: Iterable[int] = features.SPANS, size: int = SIZE) -> DataFrame:
    """``features.ewm_features`` for series of any length.

    Inside a block the mean starts anew from the block's first value f. If E is the mean at the end of the block before, the true one
    after m values is larger by q^m (E - f): a linear map, so the ends of blocks follow from one another in a fold over one row per block.
    """
    spans = list(spans)
    blocks, by_block = in_blocks(df, spec, 0, size=size)
    rows = features.ewm_features(blocks, by_block, spans)
    upto = by_block.ordered().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_m", F.count(spec.value).over(upto))
    y, m = spec.y, F.col("_m")
    last = {
        s: F.when(y.isNull(), F.col(f"ema_{s}")).when(m == 0, y).otherwise(
            dbl(1.0 - 2.0 / (s + 1)) * F.col(f"ema_{s}") + dbl(2.0 / (s + 1)) * y
        )
        for s in spans
    }
    known = y.isNotNull()
    ends = rows.groupBy(*by_block.keys).agg(
        F.min_by(F.when(known, y), F.when(known, F.col("_i"))).alias("_f"),
        F.count(y).alias("_m"),
        F.array(*[F.max_by(last[s], F.col("_i")) for s in spans]).alias("_end"),
    )
    lists = ends.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_stretch", "_f", "_m", "_end"))).alias("_all"))
    none = F.transform(F.array(*[F.lit(k) for k in range(len(spans))]), lambda _: F.lit(None).cast("double"))
    start = F.struct(none.alias("e"), F.array().cast("array<struct<stretch:bigint,f:double,e:array<double>>>").alias("out"))

    def follow(acc: Column, b: Column) -> Column:
        decay = F.array(*[F.pow(dbl(1.0 - 2.0 / (s + 1)), b["_m"].cast("double")) for s in spans])
        ended = F.transform(
            F.arrays_zip(b["_end"].alias("end"), acc["e"].alias("e"), decay.alias("q")),
            lambda v: F.when(b["_m"] == 0, v["e"]).when(v["e"].isNull(), v["end"]).otherwise(v["end"] + v["q"] * (v["e"] - b["_f"])),
        )
        came = F.struct(b["_stretch"].alias("stretch"), b["_f"].alias("f"), acc["e"].alias("e"))
        return F.struct(ended.alias("e"), F.concat(acc["out"], F.array(came)).alias("out"))

    carried = lists.select("_key", F.explode(F.aggregate("_all", start, follow)["out"]).alias("_c"))
    carried = carried.select("_key", F.col("_c.stretch").alias("_stretch"), F.col("_c.f").alias("_f"), F.col("_c.e").alias("_e"))
    rows = joined(rows, carried)
    whole = {}
    for k, s in enumerate(spans):
        carry, own = F.col("_e")[k], F.col(f"ema_{s}")
        moved = own + F.pow(dbl(1.0 - 2.0 / (s + 1)), m.cast("double")) * (carry - F.col("_f"))
        whole[f"ema_{s}"] = F.when(carry.isNull(), own).when(m == 0, carry).otherwise(moved)
    return own_rows(rows.withColumns(whole).drop("_m", "_f", "_e"))


# -- autocorrelation ---------------------------------------------------------


def acf_arrays(df: DataFrame, spec: SeriesSpec, nlags: int = 24, size: int = SIZE) -> DataFrame:
    """``stattests.acf_arrays``: products of lags are summed per block, halo rows only serve as partners."""
    blocks, by_block = in_blocks(df, spec, nlags, size=size)
    means = df.groupBy(F.struct(*spec.keys).alias("_key")).agg(F.avg(spec.value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    rows = joined(blocks, per_block(means, size)).withColumn("_d", spec.y - F.col("_mean"))
    lags = {f"_l{k}": F.lag("_d", k).over(by_block.ordered()) for k in range(1, nlags + 1)}
    rows = rows.withColumns(lags).where("_own")
    d, n = F.col("_d"), F.col("n").cast("double")
    sums = rows.groupBy("_key").agg(
        F.count("_d").alias("n"), F.array(F.sum(d * d), *[F.coalesce(F.sum(d * F.col(c)), dbl(0.0)) for c in lags]).alias("_sums")
    )
    acov = F.transform("_sums", lambda v: div(v, n))
    return sums.select("_key.*", "n", F.when(acov[0] > 0, F.transform(acov, lambda v: v / acov[0])).alias("acf"))


def acf(df: DataFrame, spec: SeriesSpec, nlags: int = 24, size: int = SIZE) -> DataFrame:
    return stattests.by_lag(acf_arrays(df, spec, nlags, size), spec, "acf")


def pacf(df: DataFrame, spec: SeriesSpec, nlags: int = 24, size: int = SIZE) -> DataFrame:
    return stattests.by_lag(stattests.with_pacf(acf_arrays(df, spec, nlags, size)), spec, "pacf")


# -- decomposition -----------------------------------------------------------


def decompose(df: DataFrame, spec: SeriesSpec, model: str = "multiplicative", size: int = SIZE) -> DataFrame:
    """``features.decompose``: the centred mean sees half a season around a block, seasonal means are grouped sums by phase."""
    if model not in ("multiplicative", "additive"):
        raise ValueError(f"unknown model {model!r}")
    p, half = spec.period, spec.period // 2
    blocks, by_block = in_blocks(df, spec, half, half, size)
    w = by_block.ordered()
    if p % 2 == 0:
        inner = F.sum(spec.value).over(w.rowsBetween(-(half - 1), half - 1))
        smooth = (inner + dbl(0.5) * (F.lag(spec.value, half).over(w) + F.lead(spec.value, half).over(w))) / dbl(float(p))
    else:
        smooth = F.avg(spec.value).over(w.rowsBetween(-half, half))
    trend = F.when(F.count(spec.y).over(w.rowsBetween(-half, half)) == 2 * half + 1, smooth)
    rows = blocks.withColumn("decomp_trend", F.when(F.col("_n") >= 2 * p, trend)).where("_own")
    rows = rows.withColumn("_phase", (F.col("_i") % p).cast("int"))
    y, t = spec.y, F.col("decomp_trend")
    detrended = div(y, t) if model == "multiplicative" else y - t
    means = rows.groupBy("_key", "_phase").agg(F.avg(detrended).alias("_mean"), F.first("_n").alias("_n"))
    season = means.groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("_phase", "_mean"))).alias("_means"), F.avg("_mean").alias("_centre"), F.first("_n").alias("_n")
    )
    rows = joined(rows, per_block(season, size))
    mean, centre = F.col("_means")[F.col("_phase")], F.col("_centre")
    seasonal = div(mean, centre) if model == "multiplicative" else mean - centre
    rows = rows.withColumn("decomp_seasonal", seasonal)
    s = F.col("decomp_seasonal")
    rows = rows.withColumn("decomp_resid", div(div(y, s), t) if model == "multiplicative" else y - s - t)
    return own_rows(rows.drop("_phase", "_means", "_centre"))
