"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.quality_rules import SPACES
from tidemill.session import cut_lineage

GROUP_PIECES = 20_000
OUT = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id string, position bigint, bin_used bigint, bin_capacity bigint"


@dataclass(frozen=True)
class Sizes:
    """Permitted sequence lengths and the cost of a sequence of each: its tokens and a fixed share."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    fixed_cost: float = 32.0

    def cost(self, capacity: int) -> float:
        return capacity + self.fixed_cost

    def cheapest(self, length: int) -> int:
        return min((c for c in self.capacities if c >= length), key=lambda c: (self.cost(c), c))


def word_count(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def best_fit(lengths: np.ndarray, sizes: Sizes, opening: int) -> tuple[np.ndarray, list[int], float]:
    """Bins of pieces given from long to short: the fullest bin that still fits, else a new one.

    A new bin has the least-cost capacity of at least ``opening`` and the piece. At the end each bin is
    brought down to the least-cost capacity that holds its contents. Returns bins, contents, cost.
    """
    room: dict[int, list[int]] = {}  # free space -> bins
    free: list[int] = []  # its keys, sorted
    bins, used = np.empty(len(lengths), np.int64), []
    opened = {}
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(free, n)
        if at < len(free):
            space = free[at]
            own = room[space]
            b = own.pop()
            if not own:
                del room[space]
                free.pop(at)
            used[b] += n
        else:
            if n not in opened:
                opened[n] = sizes.cheapest(max(n, opening))
            space, b = opened[n], len(used)
            used.append(n)
        left = space - n
        if left:
            if left not in room:
                insort(free, left)
                room[left] = []
            room[left].append(b)
        bins[i] = b
    return bins, used, sum(sizes.cost(sizes.cheapest(u)) for u in used)


def pack(lengths: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, list[int]]:
    """The cheapest packing over all least opening sizes: the permitted lengths are optimised together."""
    order = np.argsort(-lengths, kind="stable")
    runs = [best_fit(lengths[order], sizes, c) for c in sizes.capacities]
    bins, used, _ = min(runs, key=lambda r: r[2])
    out = np.empty(len(lengths), np.int64)
    out[order] = bins
    return out, used


def best_fit_packing(docs: DataFrame, sizes: Sizes = Sizes(), doc_id: str = "doc_id", text: str = "text", length: Column | None = None) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, bin_id, position, bin_used, bin_capacity).

    ``length``: tokens of a document; default its words and one end. Longer documents than the largest
    capacity are cut into pieces of that capacity and a rest. Pieces are dealt by hash into groups of
    about GROUP_PIECES, each packed by one task; a bin holds pieces of one group, at most its capacity, and every token
    of every document is in one bin. ``position``: where the piece begins in its bin.

    A null text has only its end token; documents of length 0 (or null) by a given ``length`` have one empty
    piece. Null and repeated ids and repeated rows are packed as any other; other columns are ignored.
    """
    if not sizes.capacities or min(sizes.capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(sizes.capacities)
    n = word_count(F.col(f"`{text}`")) + F.lit(1) if length is None else F.coalesce(length, F.lit(0))
    rows = cut_lineage(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), n.cast("bigint").alias("n")))
    pieces = F.greatest(F.ceil(F.col("n") / F.lit(largest)), F.lit(1)).cast("bigint")
    total = int(rows.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0])
    n_groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_PIECES))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    rows = rows.select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("length")
    )
    # rows of one id are dealt apart by a number of their own; the packing of a group depends on its rows alone
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(n_groups)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = np.asarray(table.column("length"))
        bins, used = pack(lengths, sizes)
        order = np.argsort(bins, kind="stable")
        position = np.empty(len(bins), np.int64)
        running = np.cumsum(lengths[order]) - lengths[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        position[order] = running - running[first][np.cumsum(first) - 1]
        capacity = np.array([sizes.cheapest(u) for u in used], np.int64)
        g = table.column("group")[0].as_py()
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"),
                "bin_id": pa.array([f"{g}-{b}" for b in bins.tolist()]), "position": pa.array(position),
                "bin_used": pa.array(np.array(used, np.int64)[bins]), "bin_capacity": pa.array(capacity[bins]),
            }
        )

    return rows.groupBy("group").applyInArrow(fill, OUT)
