"""Quality classifier by importance resampling over hashed n-grams (after Xie et al., 2023).

Two generative models of hashed features, one of labelled good text, one of all text, give each document the
evidence of its features against it: the sum of log(target / raw) over features that the target model holds
clearly less often. Features are words, word beginnings, what is left of a word without its letters,
and word pairs; each has a bucket in several tables and counts by the mildest, so that a rare feature does
not answer for another one in its bucket. exp(evidence + slack), at most 1, is a document's
importance weight. The sum of weights says how many documents to keep; the
Gumbel top-k draws that many without replacement, in proportion to the tempered weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import words
from tidemill.llm.batches import small_parts
from tidemill.llm.counters import corpus_counters
from tidemill.session import cut_lineage

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
BEGINNINGS = (3, 4, 5, 6)
BINS = 4096


@dataclass(frozen=True)
class Settings:
    """``max_labelled``: bound of the sample of labelled rows that is broadcast and learned from (least hashes of the id).

    ``pseudo``: occurrences added to both sides of a ratio; ``margin``: log ratio below which a feature counts;
    ``slack``: evidence that costs no weight; ``temperature`` of the draw.
    """

    tables: int = 3
    buckets: int = 1 << 17
    max_labelled: int = 50_000
    pseudo: float = 10.0
    margin: float = 1.0
    slack: float = 4.0
    temperature: float = 0.1
    seed: int = 1


class Features:
    """Features of a batch: those of a word once per distinct word, pairs once per place."""

    def __init__(self, texts: list[bytes], s: Settings):
        self.numbers, self.bounds, distinct = words.numbered(words.lower_ascii(texts))
        own = words.hashes_of(distinct)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        every = np.ones(len(distinct), bool)
        kinds = [(own, every), (words.hashes_of([w.translate(None, LETTERS) for w in distinct], 3), every)]
        kinds += [(words.hashes_of([w[:n] for w in distinct], 10 + n), sizes > n) for n in BEGINNINGS]
        self.of_word = [([self.bucket(h, t, s) for t in range(s.tables)], used) for h, used in kinds]
        pairs, self.pair_start = words.windows(own[self.numbers] if len(own) else own, self.bounds, 2)
        self.pairs = [self.bucket(pairs, t, s) for t in range(s.tables)]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    @staticmethod
    def bucket(h: np.ndarray, t: int, s: Settings) -> np.ndarray:
        at = words.mixed(h + np.uint64(t * 0x9E3779B97F4A7)) % np.uint64(s.buckets)
        return at.astype(np.int64) + t * s.buckets

    def counts(self, docs: np.ndarray, s: Settings) -> np.ndarray:
        """Counters of the features of the marked documents, all tables one after the other."""
        out = np.zeros(s.tables * s.buckets)
        chosen = docs[self.doc] if len(self.doc) else np.empty(0, bool)
        times = np.bincount(self.numbers[chosen], minlength=len(self.of_word[0][1]))
        for tables, used in self.of_word:
            for at in tables:
                out += np.bincount(at[used], times[used], len(out))
        pairs = chosen[self.pair_start]
        for at in self.pairs:
            out += np.bincount(at[pairs], minlength=len(out))
        return out.astype(np.int64)

    def evidence(self, ratio: np.ndarray, s: Settings) -> np.ndarray:
        """Per document: the log ratios below the margin, each feature by its mildest table."""

        def clear(tables: list[np.ndarray]) -> np.ndarray:
            mildest = np.max([ratio[at] for at in tables], axis=0) if len(tables[0]) else np.empty(0)
            return np.where(mildest < -s.margin, mildest, 0.0)

        n = len(self.bounds) - 1
        of_word = sum(np.where(used, clear(tables), 0.0) for tables, used in self.of_word)
        out = np.bincount(self.doc, of_word[self.numbers], n) if len(self.doc) else np.zeros(n)
        return out + np.bincount(self.doc[self.pair_start], clear(self.pairs), n)


def labelled_sample(labels: DataFrame, s: Settings, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """At most ``max_labelled`` ids, the least by hash; good: quality 1 and toxic 0 in all rows of the id."""
    of = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("bigint").alias("labelled_id"))
    good = of.agg(F.coalesce((F.min(f"`{quality}`") == 1) & (F.max(f"`{toxic}`") == 0), F.lit(False)).alias("labelled_good"))
    return good.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(s.max_labelled)


def log_ratio(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str) -> np.ndarray:
    """log(target / raw) per bucket, drawn to 0 by ``pseudo``; the raw model counts all documents."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sample = labelled_sample(labels, s)
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["labelled_id"], "left").select("text", "labelled_good")
    size = s.tables * s.buckets

    def add(table: pa.RecordBatch, counters: np.ndarray) -> None:
        for t in small_parts(table):
            texts = words.texts_of(t.column("text"))
            f = Features(texts, s)
            counters[:size] += f.counts(np.ones(len(texts), bool), s)
            good = np.asarray(t.column("labelled_good").fill_null(False).to_numpy(zero_copy_only=False), bool)
            counters[size:] += f.counts(good, s)

    counted = corpus_counters(rows, 2 * size, add).astype(float)
    raw, target = counted[:size], counted[size:]
    if not target.sum():
        return np.zeros(size)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + s.pseudo) / (expected + s.pseudo))


def gumbel(ids: list[int | None], texts: list[bytes], seed: int) -> np.ndarray:
    """Noise fixed by id, text and seed."""
    keys = words.hashes_of([f"{seed}/{i}/".encode() + t for i, t in zip(ids, texts)])
    u = (keys.astype(np.float64) + 0.5) / 2.0**64
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def judged(ids: list[int | None], texts: list[bytes], ratio: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence, weight and the key whose k largest are kept."""
    evidence = Features(texts, s).evidence(ratio, s)
    log_weight = np.minimum(0.0, evidence + s.slack)
    return evidence, np.exp(log_weight), log_weight / s.temperature + gumbel(ids, texts, s.seed)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of ``BINS`` bins over ever smaller ranges."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return float(low)
    x = F.col(column)
    for _ in range(12):
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        inside = df.where(x.between(low, high)).groupBy(F.least(F.floor((x - low) / width), F.lit(BINS - 1)).alias("bin"))
        for row in sorted(inside.agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect(), key=lambda r: -r["bin"]):
            if row["n"] >= k:
                low, high = row["a"], row["b"]
                break
            k -= row["n"]
        if low == high:
            break
    return float(low)


SCORES = "doc_id bigint, n_words bigint, evidence double, weight double, gumbel_key double"


def importance_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text"):
    """Scores of every row (written once to the shared folder), the key from which rows are kept, and the ratios."""
    ratio = log_ratio(docs, labels, s, doc_id, text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (part for table in tables for part in small_parts(table)):
            texts = words.texts_of(t.column("text"))
            evidence, weight, key = judged(t.column("doc_id").to_pylist(), texts, ratio, s)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": t.column("doc_id"), "n_words": pa.array([len(x.split()) for x in texts], pa.int64()),
                    "evidence": pa.array(evidence), "weight": pa.array(weight), "gumbel_key": pa.array(key),
                }
            )

    scored = cut_lineage(rows.mapInArrow(score, SCORES))
    k = int(round(scored.agg(F.sum("weight")).first()[0] or 0.0))
    return scored, kth_largest(scored, "gumbel_key", k), ratio


def quality_classifier(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, evidence, weight, gumbel_key, kept) for every row of ``docs``.

    k, the number kept, is the rounded sum of weights over all rows; rows tied at the k-th key all stay. A null or
    empty text has no features: weight 1. Null ids are scored as any other; repeated rows get equal
    keys and fare alike. Labels without a document, null ids and null labels teach nothing; without a good
    labelled document every weight is 1. Other columns are ignored. The driver holds the models,
    4 * tables * buckets numbers whatever the corpus.
    """
    scored, least, _ = importance_scores(docs, labels, s, doc_id, text)
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def quality_filter(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_classifier`` keeps, with all their columns; no join."""
    _, least, ratio = importance_scores(docs, labels, s, doc_id, text)

    def keep(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (part for table in tables for part in small_parts(table, text)):
            ids = t.column(doc_id).cast(pa.int64()).to_pylist()
            yield t.filter(pa.array(judged(ids, words.texts_of(t.column(text)), ratio, s)[2] >= least))

    return docs.mapInArrow(keep, docs.schema)
