"""Similarity join of documents by Jaccard of word n-grams: components of linked documents.

Tokens (n-grams) have one global order, the rarer first, by a corpus-wide table of counters of fixed length.
(1) Two similar sets share a token in their prefixes; documents ask, batch by batch, which prefix
tokens occur elsewhere. (2) Sets meet at shared prefix tokens as parity sketches, whose distance never exceeds that of the
sets: pairs that cannot be similar part there, the others are joined to candidate groups by spanning
links, without listing pairs. (3) The whole sets of a candidate group meet in a prefix tree, which
links exactly the similar ones. (4) Links become components.

Documents of equal sets are one set throughout. A large group is dealt into blocks, and pairs of blocks
meet, so that no task holds more than two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import batches, words
from tidemill.llm.components import components
from tidemill.llm.counters import corpus_counters
from tidemill.llm.set_trie import Groups, needed, spanning_links
from tidemill.session import cut_lineage

COUNTERS = 1 << 20
BLOCK_SETS = 4096
DOCS = "doc_id bigint, batch int, n_shingles bigint, digest binary, row bigint"
LINKS = "a binary, b binary"


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct n-gram hashes of each text, sorted; of fewer words, the whole sequence as one."""
    lowered = words.lower_ascii(texts)
    h, bounds = words.word_hashes(lowered)
    key, start = words.windows(h, bounds, n)
    at = np.searchsorted(start, bounds)
    out = []
    for i, t in enumerate(lowered):
        own = np.unique(key[at[i] : at[i + 1]])
        if not len(own) and bounds[i + 1] > bounds[i]:
            own = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.split()), 7)], np.uint64)
        out.append(own)
    return out


def slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def ordered(h: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return h[np.lexsort((h, rarity[slot(h)]))]


def prefix(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def sketch_bits(size: int, percent: int) -> int:
    """A power of two that suits the largest difference of similar sets."""
    other = size * 100 // percent
    apart = size + other - 2 * needed(size, other, percent)
    return max(64, 1 << int(round(np.log2(max(1, 4 * apart)))))


def sketch(h: np.ndarray, bits: int) -> bytes:
    """Parity of the tokens at each of ``bits`` places."""
    place = ((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").tobytes()


class Sets:
    """Distinct sets of a batch, in global order, with 128-bit digests."""

    def __init__(self, table: pa.Table, n: int, rarity: np.ndarray | None = None):
        found: dict[bytes, np.ndarray] = {}
        self.of_doc, self.sizes = [], []
        for h in shingles(words.texts_of(table.column("text")), n):
            digest = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
            if digest is not None:
                found.setdefault(digest, h)
            self.of_doc.append(digest)
            self.sizes.append(len(h))
        self.digests = list(found)
        self.sets = list(found.values()) if rarity is None else [ordered(h, rarity) for h in found.values()]

    def prefixes(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix tokens, set after set, and the set of each."""
        parts = [s[: prefix(len(s), percent)] for s in self.sets]
        of_set = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), of_set


def met_twice(entries: np.ndarray) -> np.ndarray:
    """Entries: 31 bits of a key, and one that says it was met twice in its batch."""
    order = np.argsort(entries, kind="stable")
    key = entries[order] >> 1
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat((size > 1) | (np.bitwise_or.reduceat(entries[order] & 1, new) > 0), size)
    return out


def packed(keys: np.ndarray, of_set: np.ndarray, digests: list[bytes], sizes: list[int], sketches: list[bytes]) -> bytes:
    met, local = np.unique(of_set, return_inverse=True)
    head = np.array([len(keys), len(met)], np.uint32)
    size = np.array([sizes[i] for i in met], np.uint32)
    width = np.array([len(sketches[i]) for i in met], np.uint32)
    table = b"".join([digests[i] for i in met] + [sketches[i] for i in met])
    return b"".join([head.tobytes(), keys.tobytes(), local.astype(np.uint32).tobytes(), size.tobytes(), width.tobytes(), table])


def unpacked(blob: bytes):
    n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at = 8
    columns = []
    for kind, size in ((np.uint64, n), (np.uint32, n), (np.uint32, m), (np.uint32, m)):
        columns.append(np.frombuffer(blob, kind, size, at))
        at += columns[-1].nbytes
    digests = [blob[at + 16 * i : at + 16 * i + 16] for i in range(m)]
    ends = at + 16 * m + np.append(0, np.cumsum(columns[3], dtype=np.int64))
    return columns[0], columns[1], digests, columns[2], [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def candidate_links(table: pa.Table, percent: int) -> pa.Table:
    """Spanning links among the sets of a bucket that share a prefix token and may be similar by size and sketch."""
    number: dict[bytes, int] = {}
    size, bits, parity, keys, of_set = [], [], [], [], []
    for blob in table.column("payload").to_pylist():
        k, local, digests, sizes, sketches = unpacked(blob)
        ids = np.empty(len(digests), np.int64)
        for i, d in enumerate(digests):
            ids[i] = number.setdefault(d, len(number))
            if ids[i] == len(size):
                size.append(int(sizes[i]))
                bits.append(8 * len(sketches[i]))
                parity.append(int.from_bytes(sketches[i], "little"))
        keys.append(k)
        of_set.append(ids[local])
    keys, of_set = np.concatenate(keys), np.concatenate(of_set)
    order = np.lexsort((of_set, keys))
    keys, of_set = keys[order], of_set[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (of_set[1:] != of_set[:-1]))
    keys, of_set = keys[new], of_set[new]
    at = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    groups, links = Groups(len(size)), []

    def may_link(x: int, y: int) -> bool:
        a, b = size[x], size[y]
        if 100 * min(a, b) < percent * max(a, b):
            return False
        p, q, m, n = parity[x], parity[y], bits[x], bits[y]
        while m > n:
            m //= 2
            p = (p >> m) ^ (p & ((1 << m) - 1))
        while n > m:
            n //= 2
            q = (q >> n) ^ (q & ((1 << n) - 1))
        return (p ^ q).bit_count() <= a + b - 2 * needed(a, b, percent)

    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        if last - first < 2:
            continue
        waiting = of_set[first:last].tolist()
        while waiting:
            reached = [waiting.pop()]
            while reached and waiting:
                x = reached.pop()
                root, rest = groups.find(x), []
                for y in waiting:
                    if groups.find(y) == root:
                        reached.append(y)
                    elif may_link(x, y):
                        groups.join(x, y)
                        root = groups.find(x)
                        links.append((x, y))
                        reached.append(y)
                    else:
                        rest.append(y)
                waiting = rest
    names = list(number)
    return pa.table(
        {"a": pa.array([names[x] for x, _ in links], pa.binary()), "b": pa.array([names[y] for _, y in links], pa.binary())}
    )


def exact_links(table: pa.Table, percent: int, rarity: np.ndarray) -> pa.Table:
    """Spanning links of the similar sets among those of a group or of two of its blocks."""
    digests = table.column("digest").to_pylist()
    sets = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
    universe = np.unique(np.concatenate(sets))
    rank = np.empty(len(universe), np.int64)
    rank[np.lexsort((universe, rarity[slot(universe)]))] = np.arange(len(universe))
    links = spanning_links([np.sort(rank[np.searchsorted(universe, s)]) for s in sets], percent)
    return pa.table(
        {"a": pa.array([digests[i] for i, _ in links], pa.binary()), "b": pa.array([digests[j] for _, j in links], pa.binary())}
    )


def jaccard_components(
    docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set holds the distinct runs of ``n`` words, A-Z lower-cased; with fewer words, the whole
    sequence. Two documents link when 100 * intersection >= ``percent`` * union; component_id is
    the smallest doc_id reachable by links, kept says whether it is the row's own. Null and
    word-less texts have no shingles and link with nothing: they are their own component. Rows with a
    null id take part, but never name a component (null if alone). Rows that share a doc_id each take
    part with their own text. Other columns are ignored. Token equality is that of 64-bit hashes.

    ``row``: a bigint column that names rows. It is returned as ``row``, and kept is then true for one name in each component: the
    least of the rows with the least id, ids before nulls.
    """
    named_rows = docs if row is None else docs.withColumnRenamed(row, "row")
    dealt = batches.batched(named_rows, doc_id, text, () if row is None else ("row",))

    def count(table: pa.RecordBatch, counters: np.ndarray) -> None:
        for t in batches.small_parts(table):
            found = np.concatenate(shingles(words.texts_of(t.column("text")), n))
            counters += np.bincount(slot(found), minlength=COUNTERS)

    counted = corpus_counters(dealt.docs.select("text"), COUNTERS, count)
    rarity = np.ceil(np.log2(counted + 1)).astype(np.uint8)  # one of 64 classes

    n_asked = dealt.buckets(0.2 * (100 - percent) / 100)
    n_met = dealt.buckets(0.02 * (100 - percent) / 100)

    def ask(table: pa.Table) -> pa.Table:
        keys, _ = Sets(table, n, rarity).prefixes(percent)
        keys, counts = np.unique(keys, return_counts=True)
        entries = ((keys >> np.uint64(33)) << np.uint64(1)).astype(np.uint32) | (counts > 1)
        return batches.ask(batches.int_at(table, "batch"), keys, entries.astype(np.uint32), n_asked)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Sets(left, n, rarity)
        keys, of_set = own.prefixes(percent)
        distinct, which = np.unique(keys, return_inverse=True)
        shared = batches.answers(right, distinct, n_asked).astype(bool)[which]
        keys, of_set = keys[shared], of_set[shared]
        used = np.unique(of_set)
        sizes = [len(s) for s in own.sets]
        sketches = [b""] * len(sizes)
        for i in used:
            sketches[i] = sketch(own.sets[i], sketch_bits(sizes[i], percent))
        order, met, bounds = batches.dealt(keys, n_met)
        keys, of_set = keys[order], of_set[order]
        blobs = [packed(keys[a:b], of_set[a:b], own.digests, sizes, sketches) for a, b in zip(bounds[:-1], bounds[1:])]
        batch = pa.array(np.full(len(met), batches.int_at(left, "batch")), pa.int32())
        return pa.table({"batch": batch, "bucket": pa.array(met, pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def describe(tables):
        for t in (part for table in tables for part in batches.small_parts(table)):
            own = Sets(t, n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": t.column("doc_id"), "batch": t.column("batch"), "n_shingles": pa.array(own.sizes, pa.int64()),
                    "digest": pa.array(own.of_doc, pa.binary()), "row": pa.nulls(t.num_rows, pa.int64()) if row is None else t.column("row"),
                }
            )

    def bring(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = {d: (g, s) for d, g, s in zip(*(right.column(c).to_pylist() for c in ("digest", "family", "sets")))}
        own = Sets(left, n) if wanted else None
        found = [(d, s) for d, s in zip(own.digests, own.sets) if d in wanted] if own else []
        return pa.table(
            {
                "family": pa.array([wanted[d][0] for d, _ in found], pa.binary()),
                "sets": pa.array([wanted[d][1] for d, _ in found], pa.int64()),
                "digest": pa.array([d for d, _ in found], pa.binary()),
                "tokens": pa.array([s.tobytes() for _, s in found], pa.binary()),
            }
        )

    by_batch = dealt.docs.groupBy("batch")
    shared = batches.answer_buckets(by_batch.applyInArrow(ask, batches.ASK), np.uint32, met_twice)
    met = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(meet, batches.ASK)
    candidates = met.groupBy("bucket").applyInArrow(lambda t: candidate_links(t, percent), LINKS)
    families = components(candidates).select(F.col("node").alias("digest"), F.col("component").alias("family"))

    described = cut_lineage(dealt.docs.mapInArrow(describe, DOCS))
    size = families.groupBy("family").agg(F.count("*").alias("sets"))
    wanted = described.join(families, "digest").groupBy("digest", "family").agg(F.min("batch").alias("batch")).join(size, "family")
    sets = by_batch.cogroup(wanted.groupBy("batch")).applyInArrow(bring, "family binary, sets bigint, digest binary, tokens binary")
    n_blocks = F.ceil(F.col("sets") / F.lit(BLOCK_SETS)).cast("int")
    sets = sets.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))
    )
    sets = sets.withColumn("other", F.explode(others)).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "tokens"
    )
    links = sets.groupBy("family", "i", "j").applyInArrow(lambda t: exact_links(t, percent, rarity), LINKS)
    found = components(links).select(F.col("node").alias("digest"), F.col("component").alias("class"))

    known = described.where("digest is not null").join(found, "digest", "left")
    known = known.select("doc_id", "n_shingles", F.coalesce("class", "digest").alias("class"), "row")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    named = known.join(known.groupBy("class").agg(F.min("doc_id").alias("component_id"), least["row"].alias("winner")), "class")
    alone = described.where("digest is null").withColumns({"component_id": F.col("doc_id"), "winner": F.col("row")})
    columns = ("doc_id", "n_shingles", "component_id", "row", "winner")
    out = named.select(*columns).unionByName(alone.select(*columns))
    if row is not None:
        return out.select("doc_id", "n_shingles", "component_id", (F.col("row") == F.col("winner")).alias("kept"), "row")
    out = out.drop("row", "winner")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
