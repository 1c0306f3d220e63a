"""Repeatable shuffles of a table's rows, the same however it is partitioned and whatever its size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
ROUNDS = 6
MASK = (1 << 64) - 1


def with_rank(df: DataFrame, ids: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the place of every row, from 0, in the order of a hash of its ids (then the ids).

    Rows are ranged by the top bits of the hash; a running sum over the counts of the 4,096 ranges gives the first
    place of each, a window inside a range the rest. No task sees more than a range.
    """
    h = F.xxhash64(*ids)
    rows = df.withColumns({"_h": h, "_range": F.shiftrightunsigned(h, 52)})
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy(F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy("_h", *ids)
    placed = rows.withColumn("_in", F.row_number().over(inside) - 1).join(first, "_range")
    return placed.select(*df.columns, (F.col("_first") + F.col("_in")).alias(name))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A bijection of 0..n-1 for every ``key``: a Feistel network on the next power of four, walked on until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    out, keys = place.astype(np.uint64), key.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x, k = out[left], keys[left]
        high, low = x >> bits, x & mask
        for r in range(ROUNDS):
            step = np.uint64((r + 1) * 0x9E3779B97F4A7C15 & MASK)
            high, low = low, high ^ (_mixed(low + _mixed(k + step)) & mask)
        out[left] = (high << bits) | low
        left = left[out[left] >= n]
    return out.astype(np.int64)


def permuted_place(place: Column, key: Column, n: int) -> Column:
    @F.pandas_udf("bigint")
    def run(p: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(permuted(p.to_numpy(), k.to_numpy(), n))

    return run(place, key)
