"""Whitening of embeddings: blockwise QR of the centred rows, then singular values and directions of the small factor.

Every task stacks a few thousand centred rows under the triangle it holds and keeps the new triangle; triangles
meet in three levels of a tree, so no task sees more than some dozens of them. R has the singular values and right
vectors of all rows. ``bidiagonal.leading`` finds them; only R, sums and a few numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.bidiagonal import EPS, leading
from tidemill.llm.counters import corpus_counters
from tidemill.session import scratch_folder

STEPS = 256
BLOCK = 4096
TREE = (4096, 64, 1)
LIMB = 21
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    """Sum of every dimension, exact beyond 64 bits: three limbs of 21 bits and more are summed apart."""

    def add(table: pa.RecordBatch, own: np.ndarray) -> None:
        x = matrix(table.column("x"), width)
        mask = (1 << LIMB) - 1
        for k, part in enumerate((x & mask, (x >> LIMB) & mask, x >> 2 * LIMB)):
            own[k * width : (k + 1) * width] += part.sum(0)

    limbs = corpus_counters(fit.select("x"), 3 * width, add).reshape(3, width)
    return [int(low) + (int(mid) << LIMB) + (int(high) << 2 * LIMB) for low, mid, high in limbs.T]


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``fit``."""
    width = len(mean)

    def stacked(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))])

    def reduce_rows(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((width, width)), 0
        for table in tables:
            x = matrix(table.column("x"), width) - mean
            for at in range(0, len(x), BLOCK):
                r = stacked([r, x[at : at + BLOCK]])
            seen += len(x)
        if seen:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        r = np.zeros((width, width))
        for blob in table.column("r").to_pylist():
            r = stacked([r, np.frombuffer(blob).reshape(width, width)])
        return pa.table({"node": table.column("node")[:1], "r": pa.array([r.tobytes()], pa.binary())})

    level = fit.select("x").mapInArrow(reduce_rows, "r binary").withColumn("node", F.spark_partition_id())
    for k in TREE:
        level = level.select(F.pmod("node", F.lit(k)).alias("node"), "r").groupBy("node").applyInArrow(meet, "node int, r binary")
    return np.frombuffer(level.first()["r"]).reshape(width, width)


def identity_error(fit: DataFrame, n: int, mean: np.ndarray, project: np.ndarray) -> float | None:
    """Largest entry in size of (covariance of the projected rows - identity), from one more pass over ``fit``."""
    width, k = project.shape
    if not k:
        return None

    def moments(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for table in tables:
            w = (matrix(table.column("x"), width) - mean) @ project
            total[0] += w.sum(0)
            total[1:] += w.T @ w
        place = np.arange((k + 1) * k)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "value": pa.array(total.ravel())})

    sums = fit.select("x").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros((k + 1) * k)
    for row in sums.collect():  # (k + 1) * k rows
        total[row["place"]] = row["value"]
    first, second = total[:k] / n, total[k:].reshape(k, k) / n
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) ** 2 by whole numbers; null where it exceeds 63 bits."""
    largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if largest**2 * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def embedding_whitening(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component up to ``components``.

    A vector c is used as whole numbers x = floor(256 c). Rows whose vector is null, empty or holds null or non-finite entries are
    left out. The fit list is each distinct x once: n of them with sums S. Components are unit eigenvectors of x's covariance
    (divisor n) by falling eigenvalue e, their entry largest in size positive. ``deviation`` is the sum of (n x - S) ** 2, null where it
    exceeds a long; ``whitened`` the projection of x - S / n over sqrt(e), ``explained`` e / trace.

    Vectors of one width can be whitened together: if there are several, those of the commonest (of equals the
    widest) are, others are left out. A direction in which the fit list does not vary (fewer distinct vectors than components, or a constant
    dimension) has whitened null and explained 0, both null where nothing varies; ``identity_error`` covers the others. Repeated rows,
    null and repeated ids keep their rows. Other columns are ignored. Without a usable row the result is empty.
    """
    spark = vectors.sparkSession
    c = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), c.alias("c"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where((F.size("c") > 0) & finite)
    rows = rows.select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(STEPS))).cast("bigint")).alias("x"))
    folder = scratch_folder(spark, "whitening")
    rows.select("x").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    width_of = fit.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width_of is None:
        return spark.createDataFrame([], OUT)
    width, n = width_of["width"], width_of["n"]
    own = F.size("x") == width
    fit, rows = fit.where(own), rows.where(own)
    sums = exact_sums(fit, width)
    mean = np.array([s / n for s in sums])
    r = triangle(fit, mean)
    trace = float((r * r).sum())
    squares, directions = leading(r, components)
    varies = squares > (width * EPS) ** 2 * squares[:1].max(initial=0.0)
    eigen = np.where(varies, squares, 0.0) / n
    project = directions[varies].T / np.sqrt(eigen[varies])
    error = identity_error(fit, n, mean, project)
    explained = [float(e / (trace / n)) if trace > 0 else None for e in eigen]
    k = len(eigen)

    def whiten(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            x = matrix(table.column("x"), width)
            if not len(x):
                continue
            whitened = np.zeros((len(x), k))
            whitened[:, varies] = (x - mean) @ project
            given = np.tile(varies, len(x))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": table.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(x) * k, n), pa.int64()),
                    "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    "whitened": pa.array(whitened.ravel(), pa.float64(), mask=~given),
                    "explained": pa.array(explained * len(x), pa.float64()),
                    "identity_error": pa.array([error] * (len(x) * k), pa.float64()),
                }
            )

    return rows.mapInArrow(whiten, OUT)
