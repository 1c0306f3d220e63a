"""Ranked search of texts by term-partitioned postings that item bundles visit one owner after another.

Terms are dealt to a few owners, the rarest to the first, so that every owner holds about as many postings. Postings are cut by
blocks of documents, which bounds any group. A bundle is a bounded set of items with sparse accumulators (item, document,
score) for one block. In each stage a cogroup brings a bundle and its owner's postings together; the owner adds its whole-number
contributions and passes the bundle on. A pair goes once its score and all that later owners can still add stay below
the bundle's k-th best score so far: as scores only grow, none of the k best is ever lost. Behind the
last owner each bundle gives its k best per item, and a ranking over bundles the final ones.

Items are worked through in bundles of bounded size; documents are read twice for each, once to count and once for the postings,
which are written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import batches, words
from tidemill.llm.counters import corpus_counters
from tidemill.session import scratch_folder

BUNDLE_ITEMS, BUNDLE_BYTES = 256, 1 << 20
BLOCK_DOCS, BLOCK_BYTES = 2048, 4 << 20
POSTED = "stage int, block bigint, postings binary"
CARRIED = "stage int, block bigint, bundle binary"
BEST = "digest string, doc_id bigint, score bigint"

_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: ASCII other than letters and digits parts terms; A-Z become small; all else stays.
FOLD = bytes(b if b in _ALNUM or b >= 128 else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Bundle:
    """Items with the rows of their terms in one matrix: term ``term[i]`` of item ``item[i]`` counts ``weight[i]`` times its saturation.

    Terms are numbered by owner; owner s has those from ``owners[s]`` to ``owners[s + 1]``.
    """

    digests: list[str]
    vocabulary: dict[bytes, int]
    owners: list[int]
    term: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    n_docs: int
    n_terms: int
    k: int


def found(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; then text, term number and occurrences of every vocabulary term in a text, by text."""
    parts = []
    for t in texts:
        own = terms_of(t)
        parts.append(np.fromiter(map(vocabulary.get, own, repeat(-1)), np.int64, len(own)))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    place = np.repeat(np.arange(len(parts)), sizes)[flat >= 0]
    width = max(len(vocabulary), 1)
    pair, times = np.unique(place * width + flat[flat >= 0], return_counts=True)
    return sizes, pair // width, pair % width, times.astype(np.int64)


def numbered_bundle(rows: list, docs: DataFrame, n_owners: int, k: int) -> Bundle | None:
    """Counts the bundle's terms over all documents, weighs them and deals them to owners; None where no document can score."""
    texts = [terms_of(r["text"].encode()) for r in rows]
    distinct = list(dict.fromkeys(t for own in texts for t in own))
    first = {t: i for i, t in enumerate(distinct)}

    def count(table: pa.RecordBatch, own: np.ndarray) -> None:
        for part in batches.small_parts(table):
            sizes, _, term, _ = found(words.texts_of(part.column("text")), first)
            own[: len(first)] += np.bincount(term, minlength=len(first))
            own[-2] += np.count_nonzero(sizes)
            own[-1] += sizes.sum()

    counted = corpus_counters(docs.select("text"), len(first) + 2, count)
    df, n_docs, n_terms = counted[:-2], int(counted[-2]), int(counted[-1])
    order = [i for i in np.argsort(df, kind="stable").tolist() if df[i] > 0]  # rare terms first
    if not order:
        return None
    before = np.cumsum(df[order]) - df[order]
    owner = (before * n_owners // int(df[order].sum())).tolist()
    number = {distinct[i]: j for j, i in enumerate(order)}
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[i]) + 1))) for i in order]
    entries: dict[tuple[int, int], int] = {}
    for i, own in enumerate(texts):
        for t in own:
            if (j := number.get(t)) is not None:
                entries[j, i] = entries.get((j, i), 0) + weight[j]
    cells = np.array(sorted((j, i, w) for (j, i), w in entries.items() if w > 0), np.int64).reshape(-1, 3)
    owners = np.searchsorted(owner, np.arange(n_owners + 1)).tolist()
    return Bundle([r["digest"] for r in rows], number, owners, *cells.T, n_docs, n_terms, k)


def posted_blocks(docs: DataFrame, bundle: Bundle) -> DataFrame:
    """One row per owner and block of documents; a block is named by its task and its place there."""
    n_owners, n_items, vocabulary = len(bundle.owners) - 1, len(bundle.digests), len(bundle.vocabulary)
    owner_of = np.repeat(np.arange(n_owners), np.diff(bundle.owners))

    def rows_of(block: int, parts: list) -> pa.RecordBatch:
        ids = np.concatenate([p[0] for p in parts])
        doc = np.concatenate([p[1] for p in parts])
        term = np.concatenate([p[2] for p in parts])
        gain = np.concatenate([p[3] for p in parts])
        order = np.argsort(term, kind="stable")
        doc, term, gain = doc[order].astype(np.uint16), term[order], gain[order].astype(np.uint32)
        most = np.zeros(vocabulary, np.int64)
        np.maximum.at(most, term, gain)
        counts = np.bincount(term, minlength=vocabulary).astype(np.uint32)
        payloads = []
        for s in range(n_owners):
            later = owner_of[bundle.term] > s
            rest = np.zeros(n_items, np.int64)
            np.add.at(rest, bundle.item[later], bundle.weight[later] * most[bundle.term[later]])
            a, b = np.searchsorted(term, bundle.owners[s : s + 2])
            own = counts[bundle.owners[s] : bundle.owners[s + 1]]
            raw = np.uint32(len(ids)).tobytes() + rest.tobytes() + own.tobytes() + gain[a:b].tobytes() + doc[a:b].tobytes()
            payloads.append(batches.compressed(raw + (ids.tobytes() if s + 1 == n_owners else b"")))
        return pa.RecordBatch.from_pydict(
            {
                "stage": pa.array(range(n_owners), pa.int32()),
                "block": pa.array([block] * n_owners, pa.int64()),
                "postings": pa.array(payloads, pa.binary()),
            }
        )

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, n, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for table in tables:
            for at in range(0, table.num_rows, BLOCK_DOCS // 4):
                for part in batches.small_parts(table.slice(at, BLOCK_DOCS // 4)):
                    texts = words.texts_of(part.column("text"))
                    sizes, doc, term, times = found(texts, bundle.vocabulary)
                    m = np.array([25 + 75 * x * bundle.n_docs // bundle.n_terms for x in sizes.tolist()], np.int64)
                    parts.append((batches.ids_of(part), doc + n, term, 1_000_000_000 * times // (1000 * times + 8 * m[doc])))
                    n, size = n + len(texts), size + sum(map(len, texts))
                    if n >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield rows_of(block, parts)
                        block, parts, n, size = block + 1, [], 0, 0
        if parts:
            yield rows_of(block, parts)

    return docs.select("doc_id", "text").mapInArrow(run, POSTED)


@dataclass
class Postings:
    n_docs: int
    rest: np.ndarray
    counts: np.ndarray
    gain: np.ndarray
    doc: np.ndarray
    ids: np.ndarray

    @classmethod
    def read(cls, blob: bytes, bundle: Bundle, stage: int) -> Postings:
        raw = batches.restored(blob)
        n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
        parts = []
        n_terms = bundle.owners[stage + 1] - bundle.owners[stage]
        for kind, size in ((np.int64, len(bundle.digests)), (np.uint32, n_terms)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        total = int(parts[1].sum())
        for kind, size in ((np.uint32, total), (np.uint16, total), (np.int64, n if stage + 2 == len(bundle.owners) else 0)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        return cls(n, *parts)


def kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Of every row; 1, the least score that counts, where a row has fewer."""
    if scores.shape[1] < k:
        return np.ones(len(scores), np.int64)
    return np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], 1)


def owner_adds(carried: bytes, own: Postings, bundle: Bundle, stage: int) -> np.ndarray:
    """Scores (item, document) of a block after the owner of ``stage``; a dropped pair stays far below its item's k-th best."""
    n_items = len(bundle.digests)
    scores = np.zeros((n_items, own.n_docs), np.int64)
    if carried:
        raw = batches.restored(carried)
        n = len(raw) // 12
        scores.ravel()[np.frombuffer(raw, np.uint32, n, 8 * n)] = np.frombuffer(raw, np.int64, n)
    ends = np.append(0, np.cumsum(own.counts.astype(np.int64)))
    low, high = np.searchsorted(bundle.term, bundle.owners[stage : stage + 2])
    runs = np.flatnonzero(np.diff(bundle.term[low:high], prepend=-1)) + low
    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), int(high)]):
        t = int(bundle.term[a]) - bundle.owners[stage]
        docs, gain = own.doc[ends[t] : ends[t + 1]], own.gain[ends[t] : ends[t + 1]].astype(np.int64)
        if len(docs):
            scores[bundle.item[a:b, None], docs[None, :]] += bundle.weight[a:b, None] * gain[None, :]
    return scores


def carried_on(scores: np.ndarray, rest: np.ndarray, k: int) -> bytes:
    """The pairs that may still be among the k best, as (scores, places)."""
    least = kth_largest(scores, k)
    place = np.flatnonzero((scores > 0) & (scores + rest[:, None] >= least[:, None]))
    return batches.compressed(scores.ravel()[place].tobytes() + place.astype(np.uint32).tobytes())


def best_of(scores: np.ndarray, ids: np.ndarray, bundle: Bundle) -> pa.Table:
    """The k best documents of the block for every item, equal scores by id."""
    least = kth_largest(scores, bundle.k)
    item, doc = np.nonzero(scores >= least[:, None])
    score = scores[item, doc]
    order = np.lexsort((ids[doc], -score, item))
    item, doc, score = item[order], doc[order], score[order]
    start = np.searchsorted(item, np.arange(len(scores)))
    top = np.arange(len(item)) - start[item] < bundle.k
    item, doc, score = item[top], ids[doc[top]], score[top]
    return pa.table(
        {
            "digest": pa.array([bundle.digests[i] for i in item.tolist()], pa.string()),
            "doc_id": pa.array(doc, pa.int64(), mask=doc == batches.NO_ID),
            "score": pa.array(score, pa.int64()),
        }
    )


def bundle_results(docs: DataFrame, bundle: Bundle) -> DataFrame:
    """(digest, doc_id, score): the k best of every block."""
    spark, n_owners = docs.sparkSession, len(bundle.owners) - 1
    folder = scratch_folder(spark, "postings")
    posted_blocks(docs, bundle).write.partitionBy("stage").parquet(folder)
    posted = spark.read.schema(POSTED).parquet(folder)

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        stage = batches.int_at(right, "stage")
        own = Postings.read(right.column("postings")[0].as_py(), bundle, stage)
        scores = owner_adds(left.column("bundle")[0].as_py(), own, bundle, stage)
        if stage + 1 == n_owners:
            return best_of(scores, own.ids, bundle)
        next_stage = pa.array([stage + 1], pa.int32())
        return pa.table({"stage": next_stage, "block": left.column("block"), "bundle": pa.array([carried_on(scores, own.rest, bundle.k)], pa.binary())})

    at = posted.where("stage = 0").select("stage", "block", F.lit(b"").alias("bundle"))
    for s in range(n_owners):
        owned = posted.where(F.col("stage") == s).groupBy("stage", "block")
        at = at.groupBy("stage", "block").cogroup(owned).applyInArrow(visit, BEST if s + 1 == n_owners else CARRIED)
    return at


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, owners: int = 4, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0, equal scores by id.

    Terms are runs of letters and digits, where all beyond ASCII counts as a letter and only A-Z are lower-cased. A term in df of the N documents with
    a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); with n of all L terms, m = 25 + 75 n N div L, a document scores the
    sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included. Null texts have no terms: such items have no
    rows, such documents are never found. Repeated rows of either table count as rows of their own: an item of
    equal rows has ranks 1..k for each. Null ids of documents rank last among equals; null item ids are kept. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked = asked.where(F.col("text").isNotNull()).withColumn("digest", F.sha2("text", 256))
    distinct = asked.groupBy("digest").agg(F.first("text").alias("text"))
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n_bundles = max(1, -(-size["n"] // BUNDLE_ITEMS), -(-size["size"] // BUNDLE_BYTES))
    best = []
    for b in range(n_bundles):
        own = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(n_bundles)) == b).collect()  # some 256 items and 1 MB by hash
        bundle = numbered_bundle(sorted(own, key=lambda r: r["digest"]), rows, owners, k)
        if bundle is not None:
            best.append(bundle_results(rows, bundle))
    if not best:
        kind = asked.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("digest").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.drop("text").join(ranked, "digest").select("item_id", "rank", "doc_id", "score")
