"""Removal of passages that occur earlier in the corpus: fixed-block anchors, extended to exact repeats.

Reference blocks of ``block`` words start at every ``block``-th word of a document. A window of
``window >= 2 * block - 1`` words contains a whole block, so each of its repeats holds the same words at some
place. (1) Every rolling window of ``block`` words probes the index of blocks: a key
is an anchor where a block holds it and it occurs at least twice. (2) Anchors are extended to all
windows of ``window`` words around them; windows of equal words are brought together, and all but the
earliest are repeats. (3) Overlapping repeats merge into maximal ones, whose words go.

Extension compares windows by content within a bucket of hashes, never occurrence by
occurrence, so a passage found in a third of all documents costs one entry a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import batches, words

WORDS_PER_BYTE = 0.2
REPEATS_PER_BYTE = 0.2
CHECK = np.uint64(0xD6E8FEB86659FD93)


class Passages:
    """Words of a batch in document order, the probes over them and their windows."""

    def __init__(self, table: pa.Table, window: int, n_buckets: int):
        self.table = batches.in_order(table)
        self.texts = words.texts_of(self.table.column("text"))
        self.ids = batches.ids_of(self.table)
        self.h, self.bounds = words.word_hashes(self.texts)
        self.window, self.block, self.n_buckets = window, (window + 1) // 2, n_buckets
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.bounds))
        keys, self.probes = words.windows(self.h, self.bounds, self.block)
        self.keys, self.which = np.unique(keys, return_inverse=True)

    def anchors_asked(self) -> np.ndarray:
        """Per distinct probe: 30 bits of its key, is it met as a block, is it met twice here."""
        place = self.probes - self.bounds[self.doc[self.probes]] if len(self.probes) else self.probes
        block = np.bincount(self.which[place % self.block == 0], minlength=len(self.keys)) > 0
        twice = np.bincount(self.which, minlength=len(self.keys)) > 1
        return ((self.keys >> np.uint64(34)) << np.uint64(2)).astype(np.uint32) | (twice.astype(np.uint32) << 1) | block

    def extended(self, table: pa.Table) -> None:
        """Windows that contain an anchor: their places, keys, and the earliest of each key."""
        own = table.filter(pa.array(np.asarray(table.column("bucket")) < self.n_buckets)) if table.num_rows else table
        anchor = batches.answers(own, self.keys, self.n_buckets).astype(bool)
        hits = np.zeros(len(self.h) + 1, np.int64)
        hits[self.probes[anchor[self.which]] + 1] = 1
        hits = np.cumsum(hits)
        key, start = words.windows(self.h, self.bounds, self.window)
        inside = hits[start + self.window - self.block + 1] > hits[start] if len(start) else np.empty(0, bool)
        check, _ = words.windows(self.h, self.bounds, self.window, CHECK)
        self.start, key, check = start[inside], key[inside], check[inside]
        _, first, self.same = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(first)  # by place, so that documents and places run in order
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.same, first = rank[self.same], first[order]
        self.window_key, self.check = key[first], check[first].astype(np.uint32)
        self.first_doc = self.ids[self.doc[self.start[first]]]
        self.first_at = self.place(self.start[first])

    def place(self, start: np.ndarray) -> np.ndarray:
        return start - self.bounds[self.doc[start]] if len(start) else np.empty(0, np.int64)

    def removed(self, table: pa.Table) -> np.ndarray:
        """For each word: does a repeat cover it?"""
        second = table.filter(pa.array(np.asarray(table.column("bucket")) >= self.n_buckets)) if table.num_rows else table
        least = batches.answers(second, self.window_key, self.n_buckets).astype(bool)
        own = (self.ids[self.doc[self.start]] == self.first_doc[self.same]) & (self.place(self.start) == self.first_at[self.same])
        repeat = self.start[~(own & least[self.same])]
        cover = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(cover, repeat, 1)
        np.add.at(cover, repeat + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def packed(key: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Columns one after the other, documents as runs: they compress where rows would not."""
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    runs = np.diff(np.append(new, len(doc))).astype(np.uint32)
    head = np.array([len(key), len(new)], np.uint32)
    return b"".join(x.tobytes() for x in (head, key, check, doc[new], runs, at.astype(np.uint32)))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at, out = 8, []
    for kind, size in ((np.uint64, n), (np.uint32, n), (np.int64, m), (np.uint32, m), (np.uint32, n)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return out[0], out[1], np.repeat(out[2], out[3]), out[4]


def anchors(entries: np.ndarray) -> np.ndarray:
    """1 where a block holds the key and the key occurs at least twice."""
    order = np.argsort(entries, kind="stable")
    key = entries[order] >> 2
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    if not len(new):
        return np.empty(0, np.uint8)
    size = np.diff(np.append(new, len(key)))
    block = np.bitwise_or.reduceat(entries[order] & 1, new)
    twice = np.bitwise_or.reduceat((entries[order] >> 1) & 1, new)
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat((block & (twice | (size > 1))).astype(np.uint8), size)
    return out


def earliest(table: pa.Table, shift: int) -> pa.Table:
    """1 for entries that hold the least (document, place) of their window."""
    parts = [unpacked(b) for b in table.column("payload").to_pylist()]
    key, check, doc, at = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((at, doc, check, key))
    k, c, d, a = key[order], check[order], doc[order], at[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    group = np.cumsum(new) - 1
    out = np.empty(len(key), np.uint8)
    out[order] = (d == d[new][group]) & (a == a[new][group])
    ends = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    return batches.answer_rows(table, [out[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], shift)


def substring_dedup(
    docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), keep_layout: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, *carry) for every row of ``docs``.

    A word goes if a window of ``window`` words around it occurs earlier: in a smaller doc_id, or in the same
    document at an earlier start. Windows never cross documents and are judged on the input. kept_text
    is the rest, joined by single spaces; with ``keep_layout`` a document without removals keeps its text as it is.

    A null text has no words (kept_text is empty, or null with ``keep_layout``). A null id counts as
    the largest; rows with equal ids are the same place, so repeated rows do not remove each other.
    Columns not in ``carry`` are ignored. Equality is that of 96 hash bits of the words.
    """
    if window < 2:
        raise ValueError("window must have two words or more")
    dealt = batches.batched(docs, doc_id, text, carry)
    n_buckets = dealt.buckets(WORDS_PER_BYTE)

    def probe(table: pa.Table) -> pa.Table:
        p = Passages(table, window, n_buckets)
        return batches.ask(batches.int_at(table, "batch"), p.keys, p.anchors_asked(), n_buckets)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Passages(left, window, n_buckets)
        p.extended(right)
        order, met, bounds = batches.dealt(p.window_key, n_buckets)
        columns = [x[order] for x in (p.window_key, p.check, p.first_doc, p.first_at)]
        blobs = [packed(*(c[a:b] for c in columns)) for a, b in zip(bounds[:-1], bounds[1:])]
        batch = pa.array(np.full(len(met), batches.int_at(left, "batch")), pa.int32())
        return pa.table({"batch": batch, "bucket": pa.array(met, pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Passages(left, window, n_buckets)
        p.extended(right)
        gone = p.removed(right)
        kept, n_removed = [], []
        for i, t in enumerate(p.texts):
            mask = gone[p.bounds[i] : p.bounds[i + 1]]
            n = int(mask.sum())
            n_removed.append(n)
            if n == 0 and keep_layout:
                kept.append(None if p.table.column("text")[i].as_py() is None else t)
            elif n == 0:
                kept.append(b" ".join(t.split()))
            else:
                own = t.split()
                kept.append(b" ".join([own[j] for j in np.flatnonzero(~mask)]))
        out = {
            "doc_id": p.table.column("doc_id"),
            "n_words": pa.array(np.diff(p.bounds), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        return pa.table(out | {c: p.table.column(c) for c in carry})

    types = dict(dealt.docs.dtypes)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string" + "".join(f", `{c}` {types[c]}" for c in carry)
    by_batch = dealt.docs.groupBy("batch")
    first = batches.answer_buckets(by_batch.applyInArrow(probe, batches.ASK), np.uint32, anchors)
    asked = by_batch.cogroup(first.groupBy("batch")).applyInArrow(extend, batches.ASK)
    second = asked.groupBy("bucket").applyInArrow(lambda t: earliest(t, n_buckets), batches.ANSWER)
    return by_batch.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(cut, schema)
