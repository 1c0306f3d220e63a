"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node of ``links``.

    Links with a null end or of a node to itself are ignored. Every round is four
    aggregations or joins by node, cut by a reliable checkpoint; a node with many links is
    met by partial aggregates and by joins that adaptive execution may split. Only the size
    and a checksum of the links come to the driver. The number of rounds grows with the logarithm
    of the longest path; more than ``max_rounds`` raises, nothing is cut short.
    """
    a, b = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = cut_lineage(
        links.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    low = edges.groupBy("u").agg(F.min("v").alias("component"))
    tops = low.select(F.col("component").alias("node"), "component").distinct()
    return low.select(F.col("u").alias("node"), "component").unionByName(tops)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], row[1], row[2]
