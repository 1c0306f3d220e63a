"""Batches of documents that several passes meet again, and keys exchanged between batches.

Corpus-wide questions about keys (is this block of words found elsewhere, how often
does this word occur) are answered in three steps, each a Spark shuffle:

1. documents are dealt into batches of a few MB by a hash of their columns; a batch
   sends each distinct key once, packed by bucket of the key, so that a key found in a third
   of all documents costs one entry a batch;
2. a bucket, bounded in size, decides about its keys and answers every batch in the order asked;
3. batches meet their answers in a cogroup. Spark reuses the exchange that dealt the
   documents, so texts are shuffled once however many passes follow.

Batches and buckets are functions of the rows alone: a task run again on another
executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
PART_BYTES = 2 << 20
BUCKET_KEYS = 2_000_000
NO_ID = np.iinfo(np.int64).max
ASK = "batch int, bucket int, payload binary"
ANSWER = "batch int, bucket int, answer binary"


@dataclass(frozen=True)
class Batched:
    """``docs`` has the columns batch, doc_id, text; the rest are counts derived from the text bytes."""

    docs: DataFrame
    n_batches: int
    total_bytes: int

    def buckets(self, keys_per_byte: float) -> int:
        """Number of buckets that keeps each near BUCKET_KEYS keys, whatever the size of the input."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(parts, -(-int(self.total_bytes * keys_per_byte) // BUCKET_KEYS))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one row comes back."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")).cast("bigint")), F.lit(0))).first()[0])


def batched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES) -> Batched:
    """Deals documents into batches by a hash of id and text; of the other columns those in ``carry`` stay."""
    if {"batch", "doc_id", "text"} & {*carry}:
        raise ValueError(f"cannot carry {carry} under these names")
    total = text_bytes(docs, text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-total // batch_bytes))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`") for c in carry))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"), "*")
    return Batched(rows, n, total)


def dealt(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts keys by bucket, the buckets met, and the bounds of their runs."""
    bucket = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    met, first = np.unique(bucket[order], return_index=True)
    return order, met, np.append(first, len(keys))


def ask(batch: int, keys: np.ndarray, columns: np.ndarray, n_buckets: int) -> pa.Table:
    """One row per bucket met; ``columns`` is a structured or plain array aligned with ``keys``."""
    order, met, bounds = dealt(keys, n_buckets)
    columns = columns[order]
    payload = [columns[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.table(
        {
            "batch": pa.array(np.full(len(met), batch), pa.int32()),
            "bucket": pa.array(met, pa.int32()),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def answers(table: pa.Table, keys: np.ndarray, n_buckets: int, dtype=np.uint8, read: Callable[[bytes], bytes] = bytes) -> np.ndarray:
    """Answers of all buckets, back in the order of ``keys``."""
    order, _, _ = dealt(keys, n_buckets)
    by_bucket = table.sort_by("bucket").column("answer").to_pylist()
    out = np.empty(len(keys), dtype)
    out[order] = np.frombuffer(b"".join(map(read, by_bucket)), dtype)
    return out


def answer_buckets(asked: DataFrame, dtype: np.dtype, decide: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``decide`` sees all entries of a bucket and gives one answer per entry."""
    dtype = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("payload").to_pylist()
        sizes = [len(b) // dtype.itemsize for b in blobs]
        given = decide(np.frombuffer(b"".join(blobs), dtype))
        at = np.append(0, np.cumsum(sizes))
        parts = [given[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": pa.array(parts, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def restored(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def answer_rows(table: pa.Table, given: list[bytes], shift: int = 0) -> pa.Table:
    """Answers to the rows of ``table``, one by one; ``shift`` tells a second question's buckets from the first's."""
    bucket = np.asarray(table.column("bucket")) + shift
    return pa.table({"batch": table.column("batch"), "bucket": pa.array(bucket, pa.int32()), "answer": pa.array(given, pa.binary())})


def ids_of(table: pa.Table, column: str = "doc_id") -> np.ndarray:
    """Ids as int64; a null sorts after all others."""
    return np.asarray(table.column(column).cast(pa.int64()).fill_null(NO_ID)).astype(np.int64)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by doc_id; nulls last."""
    return table.take(pa.array(np.argsort(ids_of(table), kind="stable")))


def small_parts(table: pa.RecordBatch, text: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch of Spark's as slices of about ``most`` bytes of text (or one row), so that arrays over its words stay small."""
    sizes = np.asarray(pc.binary_length(table.column(text)).fill_null(0)).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if b > a:
            yield table.slice(a, b - a)


def int_at(table: pa.Table, column: str, default: int = 0) -> int:
    """The value that all rows of a group share."""
    return table.column(column)[0].as_py() if table.num_rows else default
