"""Scores of texts by a bigram model whose counts lie in a log-frequency Bloom filter.

Counts of bigrams are summed over all training documents and quantised to level 1 + floor(log2(count)). A
bigram of level q enters a filter q times, as (bigram, 1) .. (bigram, q). The filter is split by bucket of
the bigram; a bucket's part has so many bits an entry, however large the corpus. A scorer asks for
(bigram, 1), (bigram, 2), ... until an answer is no; the level found stands for a count of 2 ** (level - 1),
never more than was counted but for false positives. Nothing of it is broadcast: the bucket that counts its
bigrams probes its part for the batches that ask, as another bucket gives them the exact counts of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import batches, words

END = b" "  # closing token of every text; no word holds a space
END_HASH = words.hashes_of([END])[0]
TOKENS_PER_BYTE, BIGRAMS_PER_BYTE = 0.06, 0.15
OUT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
    "n_words bigint"
)


@dataclass(frozen=True)
class Model:
    """``bits``: about the largest part of the filter, more buckets are taken rather than larger parts; ``bits_per_entry``
    and ``probes``: of a filter of any size.

    ``bigram_share``: part of each token's probability that comes from bigrams.
    """

    bits: int = 1 << 28
    probes: int = 4
    bigram_share: float = 0.2
    bits_per_entry: int = 16


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, remainder 1 by 5; a null id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5) == F.lit(1), F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token, bounds, and the hashes of the distinct tokens, ascending: the order of the texts leaves no trace in them."""
    numbers, bounds, distinct = words.numbered(words.lower_ascii(texts), END)
    hashes = words.hashes_of(distinct)
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return rank[numbers], bounds, hashes[order]


def bigrams(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Key of (token before, token) for every token; the first follows the end of a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1]] = END_HASH
    return words.mixed(before * words.MIX_A + h)


def probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit of each (key, level) and the step to its next, before the remainder by the size: double hashing."""
    first = words.mixed(keys + np.uint64(level * int(words.MIX_B) & (1 << 64) - 1))
    return first, words.mixed(first) | np.uint64(1)


def filter_bits(keys: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """The part of the filter that holds these keys, as large as its entries ask."""
    level = np.frexp(counts.astype(float))[1]  # 1 + floor(log2(count)), 0 for 0
    bits = np.zeros(-(-int(level.sum()) * model.bits_per_entry // 64) * 64, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        first, step = probe(keys[level >= q], q)
        for k in range(model.probes):
            bits[(first + step * np.uint64(k)) % np.uint64(len(bits))] = True
    return np.packbits(bits, bitorder="little")


def levels(keys: np.ndarray, bits: np.ndarray, model: Model) -> np.ndarray:
    """Level of each key by repeated membership probes."""
    out = np.zeros(len(keys), np.uint8)
    left, level = np.arange(len(keys) if len(bits) else 0), 1
    while len(left) and level < 63:
        first, step = probe(keys[left], level)
        for k in range(model.probes):
            at = (first + step * np.uint64(k)) % np.uint64(8 * len(bits))
            held = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            left, first, step = left[held], first[held], step[held]
        out[left] = level
        level += 1
    return out


def sent(batch: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.Table:
    """One row per bucket: its keys, then their counts; columns compress where rows would not."""
    order, met, bounds = batches.dealt(keys, n_buckets)
    keys, counts = keys[order], counts[order].astype(np.uint32)
    blobs = [keys[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.table(
        {
            "batch": pa.array(np.full(len(met), batch), pa.int32()), "bucket": pa.array(met, pa.int32()), "payload": pa.array(blobs, pa.binary()),
        }
    )


def received(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their total counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


REST = np.uint64((1 << 40) - 1)


def short_keys(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 40 more bits of a bigram's key: enough among the bounded number of keys of a bucket."""
    bucket = (keys & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)
    return (bucket << np.uint64(40)) | (keys >> np.uint64(24))


def bigrams_sent(batch: int, keys: np.ndarray, counts: np.ndarray, shift: int) -> pa.Table:
    """As ``sent``, with sorted ``short_keys``: 5 bytes each, the bucket goes without saying. ``shift`` tells these buckets from those of tokens."""
    met, first = np.unique(keys >> np.uint64(40), return_index=True)
    bounds = np.append(first, len(keys))
    rest, counts = keys & REST, counts.astype(np.uint32)
    low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
    blobs = [low[a:b].tobytes() + counts[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.table(
        {
            "batch": pa.array(np.full(len(met), batch), pa.int32()), "bucket": pa.array(met.astype(np.int32) + shift, pa.int32()),
            "payload": pa.array(blobs, pa.binary()),
        }
    )


def bigrams_received(bucket: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 9
    low, high = np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint8, n, 8 * n)
    return (np.uint64(bucket << 40) | (high.astype(np.uint64) << np.uint64(32)) | low), np.frombuffer(blob, np.uint32, n, 4 * n)


def lm_scores(docs: DataFrame, held_out: Column | None = None, model: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_words) for every row.

    Tokens: words, A-Z lower-cased, then one end. base_score: add-0.5 unigrams over the training rows;
    score: bigram_share * count(before, token) / count(before) + the rest of the share by the unigram, in log10, the
    bigram counts read from the filter and held to count(before), so that a token's probabilities
    sum to at most one. ``held_out``: rows not learned from; default by the id.

    A null text is empty: one end token. Null ids are training rows; repeated ids and rows give one
    result each; other columns are ignored. Without training rows every count is zero. Token
    identity is that of 64-bit hashes. The filter has ``model.bits_per_entry`` bits for each level of each bigram, so the
    share of false positives (0.24 % of probes by default) is the same for every corpus.
    """
    if min(model.bits, model.bits_per_entry, model.probes) < 1:
        raise ValueError("bits, bits_per_entry and probes must be positive")
    flag = is_held_out(F.col(f"`{doc_id}`")) if held_out is None else held_out
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), flag.alias("held_out"))
    dealt = batches.batched(rows, carry=("held_out",))
    n_tokens = dealt.buckets(TOKENS_PER_BYTE)
    n_bigrams = max(dealt.buckets(BIGRAMS_PER_BYTE), -(-int(dealt.total_bytes * BIGRAMS_PER_BYTE) * model.bits_per_entry // model.bits))

    def trained(table: pa.Table | pa.RecordBatch) -> tuple:
        """All tokens of a batch, and a mask of those to learn from."""
        numbers, bounds, hashes = tokens(words.texts_of(table.column("text")))
        learn = ~np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
        return numbers, bounds, hashes, np.repeat(learn, np.diff(bounds))

    def tokens_sent(table: pa.Table | pa.RecordBatch, batch: int) -> pa.Table:
        numbers, _, hashes, learn = trained(table)
        return sent(batch, hashes, np.bincount(numbers[learn], minlength=len(hashes)), n_tokens)

    def all_tokens(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (part for table in tables for part in batches.small_parts(table, most=batches.BATCH_BYTES)):
            yield from tokens_sent(t, 0).to_batches()

    def total(table: pa.Table) -> pa.Table:
        parts = [received(b) for b in table.column("payload").to_pylist()]
        keys, counts = summed(parts)
        return batches.answer_rows(table, [counts[np.searchsorted(keys, k)].tobytes() for k, _ in parts])

    def sizes(table: pa.Table) -> pa.Table:
        _, counts = summed([received(b) for b in table.column("payload").to_pylist()])
        return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})

    # sizes are counted where the documents lie; only the scoring below deals out texts
    plain = dealt.docs.select("text", "held_out")
    per_bucket = plain.mapInArrow(all_tokens, batches.ASK).groupBy("bucket").applyInArrow(sizes, "n bigint, v bigint")
    whole = per_bucket.agg(F.sum("n"), F.sum("v")).first()
    n_train, vocabulary = int(whole[0] or 0), int(whole[1] or 0)

    def ask(table: pa.Table) -> pa.Table:
        """Tokens and bigrams of a batch, each with how often the batch learns from it."""
        batch = batches.int_at(table, "batch")
        numbers, bounds, hashes, learn = trained(table)
        counts = np.bincount(numbers[learn], minlength=len(hashes))
        keys, which = np.unique(short_keys(bigrams(hashes[numbers], bounds), n_bigrams), return_inverse=True)
        pairs = bigrams_sent(batch, keys, np.bincount(which[learn], minlength=len(keys)), n_tokens)
        return pa.concat_tables([sent(batch, hashes, counts, n_tokens), pairs])

    def answer(table: pa.Table) -> pa.Table:
        """Counts of tokens, levels of bigrams."""
        bucket = batches.int_at(table, "bucket")
        if bucket < n_tokens:
            return total(table)
        parts = [bigrams_received(bucket - n_tokens, b) for b in table.column("payload").to_pylist()]
        keys, counts = summed(parts)
        level = levels(keys, filter_bits(keys, counts, model), model)
        return batches.answer_rows(table, [level[np.searchsorted(keys, k)].tobytes() for k, _ in parts])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, bounds, hashes, _ = trained(left)
        of_tokens = np.asarray(right.column("bucket")) < n_tokens
        counts = batches.answers(right.filter(pa.array(of_tokens)), hashes, n_tokens, np.int64)
        unigram = (counts + 0.5) / (n_train + 0.5 * (vocabulary + 1))
        keys, which = np.unique(short_keys(bigrams(hashes[numbers], bounds), n_bigrams), return_inverse=True)
        # keys are in order, and so by bucket
        given = right.filter(pa.array(~of_tokens)).sort_by("bucket").column("answer").to_pylist()
        level = np.frombuffer(b"".join(given), np.uint8)[which]
        before = np.empty_like(numbers)
        before[1:] = numbers[:-1]
        end = np.flatnonzero(hashes == END_HASH)
        before[bounds[:-1]] = end[0] if len(end) else 0
        context = counts[before]
        pair = np.where(level > 0, np.minimum(np.exp2(level - 1.0), context), 0.0) / np.maximum(context, 1)
        mixed = np.log10(model.bigram_share * pair + (1 - model.bigram_share) * unigram[numbers])
        base, at = np.log10(unigram)[numbers], bounds[:-1]
        n = np.diff(bounds)
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts > 0)[numbers].astype(np.int64), at), pa.int64()),
                "train_tokens": pa.array(np.full(len(n), n_train), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(mixed, at)),
                "n_words": pa.array(n - 1, pa.int64()),
            }
        )

    by_batch = dealt.docs.groupBy("batch")
    counted = by_batch.applyInArrow(ask, batches.ASK).groupBy("bucket").applyInArrow(answer, batches.ANSWER)
    return by_batch.cogroup(counted.groupBy("batch")).applyInArrow(score, OUT)
