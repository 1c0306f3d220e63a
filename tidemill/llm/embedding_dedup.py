"""Near-duplicate vectors by cosine: int8 tile products with error bounds, doubles where they cannot decide.

Equal vectors of one label are one class. The classes of a label are dealt into tiles, and every pair of tiles
meets in one task. A unit vector u is held as integers q with u = s * q + e; from |e| and |s * q| of both
vectors follows a bound of |u . v - s t (q . r)|. A pair is computed in doubles only if
its integer product plus that bound reaches the threshold. Tasks return a count of links per class and links that
connect the tile's groups, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.set_trie import Groups
from tidemill.session import cut_lineage

TILE = 4096
BLOCK = 1024
FOUND = "class bigint, links bigint, other bigint"


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, |e| rounded up, and |s * q| rounded up."""
    scale = np.abs(unit).max(1, initial=0.0) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = scale[:, None] * q
    up = 1 + 1e-12
    return q, scale, np.sqrt(((unit - near) ** 2).sum(1)) * up + 1e-15, np.sqrt((near**2).sum(1)) * up


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose cosine in doubles is at least the threshold."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    (a, s, ea, na), (b, t, eb, nb) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    # whole numbers up to 127 * 127 * width are exact in single precision while below 2 ** 24
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    product = (a.astype(kind) @ b.astype(kind).T).astype(np.float64) * (s[:, None] * t[None, :])
    bound = ea[:, None] * nb[None, :] + na[:, None] * eb[None, :] + ea[:, None] * eb[None, :] + 1e-9
    i, j = np.nonzero(product + bound >= threshold)
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 100_000):
        p, r = i[at : at + 100_000], j[at : at + 100_000]
        out[at : at + 100_000] = (x[p] * y[r]).sum(1) / (nx[p] * ny[r]) >= threshold
    return i[out], j[out]


def tile_pair(table: pa.Table, threshold: float) -> pa.Table:
    """Of the classes of two tiles (or one): links per class, weighted by the other's copies, and spanning links."""
    ids = np.asarray(table.column("class"))
    copies = np.asarray(table.column("copies"))
    flat = np.asarray(table.column("vector").combine_chunks().flatten())
    vectors = flat.reshape(len(ids), -1)
    tile, left, right = (np.asarray(table.column(c)) for c in ("tile", "i", "j"))
    x, y = np.flatnonzero(tile == left[0]), np.flatnonzero(tile == right[0])
    links, groups, spans = np.zeros(len(ids), np.int64), Groups(len(ids)), []
    for at in range(0, len(x), BLOCK):
        for to in range(0, len(y), BLOCK):
            p, r = similar(vectors[x[at : at + BLOCK]], vectors[y[to : to + BLOCK]], threshold)
            p, r = x[at + p], y[to + r]
            once = p < r if left[0] == right[0] else np.ones(len(p), bool)
            p, r = p[once], r[once]
            np.add.at(links, p, copies[r])
            np.add.at(links, r, copies[p])
            spans += [(a, b) for a, b in zip(p.tolist(), r.tolist()) if groups.join(a, b)]
    met = np.flatnonzero(links)
    return pa.table(
        {
            "class": pa.array(np.concatenate([ids[met], ids[[a for a, _ in spans]] if spans else np.empty(0, np.int64)]), pa.int64()),
            "links": pa.array(np.concatenate([links[met], np.zeros(len(spans), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(met) + [int(ids[b]) for _, b in spans], pa.int64()),
        }
    )


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of one label (null labels excluded) and one length link when their cosine in doubles reaches ``threshold``.
    n_links counts other rows linked directly; component_id is the least vec_id reachable.
    Null, empty and zero vectors, those with a null or non-finite component, and those without a label link
    with nothing. Repeated ids: each row takes part, counts as its own row, and rows of one id
    share a component if any links. A null id takes part but names no component. Other columns are ignored.
    """
    e = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), e.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    nonzero = F.exists("vector", lambda v: v != F.lit(0.0))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & nonzero, F.lit(False))
    # -0.0 equals 0.0 in a cosine
    rows = rows.withColumn("usable", usable).withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda v: v + F.lit(0.0))))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    own = rows.where("usable").withColumn("class", F.xxhash64("label", "vector"))
    width = F.size("vector")
    classes = cut_lineage(
        own.groupBy("class").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")
        )
    )
    sizes = classes.groupBy("label", width.alias("width")).agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = classes.withColumn("width", width).join(sizes, ["label", "width"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "label", "width", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "class", "copies", "vector"
    )
    found = cut_lineage(dealt.groupBy("label", "width", "i", "j").applyInArrow(lambda t: tile_pair(t, threshold), FOUND))
    links = found.where("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null"), "class", "other")
    named = (
        classes.select("class", "copies", "vec_id")
        .join(links, "class", "left")
        .join(groups.select(F.col("node").alias("class"), F.col("component").alias("group")), "class", "left")
        .withColumn("group", F.coalesce("group", "class"))
    )
    least = named.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "group").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = own.select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
