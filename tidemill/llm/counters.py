"""Arrays of counters of fixed length, summed over the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 14


def corpus_counters(df: DataFrame, length: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """``add(batch, counters)`` over all rows; every task sums its own, slices are summed by key.

    Only ``length`` numbers, a constant, come to the driver; the tasks shuffle one array each.
    """

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(length, np.int64)
        for t in tables:
            add(t, own)
        used = [k for k in range(0, length, SLICE) if own[k : k + SLICE].any()]
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(used, pa.int32()), "counts": pa.array([own[k : k + SLICE].tobytes() for k in used], pa.binary())}
        )

    def total(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()]
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([np.sum(parts, 0, dtype=np.int64).tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    out = np.zeros(length, np.int64)
    for row in df.mapInArrow(count, schema).groupBy("slice").applyInArrow(total, schema).collect():
        part = np.frombuffer(row["counts"], np.int64)
        out[row["slice"] : row["slice"] + len(part)] = part
    return out
