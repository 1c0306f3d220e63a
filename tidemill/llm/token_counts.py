"""Token counts of whole texts without token ids.

A byte-level BPE never merges across pre-tokens, so the length of a text in tokens is the sum
of the lengths of its pre-tokens. Every distinct pre-token is encoded once for the
whole corpus; its piece count is joined back to the documents' pre-token frequencies.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemill.llm import batches, words

#: Fixed value: the pre-token pattern of the byte-level BPE, before its classes (letters, numbers, spaces) are filled in.
SHAPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}
PATTERN = SHAPE.format(**CLASSES)
#: Outside these ranges Unicode versions disagree about letters; there the library's own splitter is asked.
UNCOMMON = r"[^\x00-\u052F\u2000-\u206F]"
PRETOKENS_PER_BYTE = 0.02  # distinct ones of a batch, for the number of buckets
OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


@cache
def common_splitter() -> Callable[[str], list[str]]:
    """PATTERN for texts without uncommon characters. With the members of each class written out ``re`` can split, in half the time of ``regex``."""
    common = regex.sub(UNCOMMON, "", "".join(map(chr, range(0x2070))))
    return re.compile(SHAPE.format(**{k: re.escape("".join(regex.findall(c, common))) for k, c in CLASSES.items()})).findall


@cache
def library(model: str):
    """One for all tasks of a Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


@cache
def library_splitter(model: str) -> Callable[[str], list[str]]:
    split = library(model).pre_tokenizer.pre_tokenize_str
    return lambda text: [text[a:b] for _, (a, b) in split(text)]


def pretokens(texts: list[bytes], special: tuple[str, ...], model: str) -> Iterator[tuple[list[str], int]]:
    """Pre-tokens of each text in their order, without the special strings, and the number of these."""
    common, uncommon = common_splitter(), regex.compile(UNCOMMON).search
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        find = common if text.isascii() or uncommon(text) is None else library_splitter(model)
        if cut is not None and any(s in text for s in special):
            parts = cut.split(text)
            yield [p for part in parts for p in find(part)], len(parts) - 1
        else:
            yield find(text), 0


def distinct_pretokens(texts: list[bytes], special: tuple[str, ...], model: str) -> list[str]:
    """Those of ``frequencies``, without their frequencies."""
    known: set[str] = set()
    for found, _ in pretokens(texts, special, model):
        known.update(found)
    return sorted(known)


def frequencies(texts: list[bytes], special: tuple[str, ...], model: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, sorted, so that the order of the texts leaves no trace in them; (text, pre-token, frequency) triples in text order;
    special strings per text."""
    known: dict[str, int] = defaultdict()
    known.default_factory = known.__len__
    number = known.__getitem__
    numbers, extra = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
    for i, (found, extra[i]) in enumerate(pretokens(texts, special, model)):
        numbers.append(np.fromiter(map(number, found), np.int32, len(found)))
    known.default_factory = None  # it refers to the dict: all pre-tokens would stay until Python looks for cycles
    distinct = sorted(known)
    rank = np.empty(len(distinct), np.int64)
    rank[[known[p] for p in distinct]] = np.arange(len(distinct))
    place = np.repeat(np.arange(len(texts)) * len(distinct), [len(n) for n in numbers[1:]])
    places, counts = np.unique(place + rank[np.concatenate(numbers)], return_counts=True)
    which, columns = np.divmod(places, max(len(distinct), 1))
    return distinct, np.bincount(which, minlength=len(texts)), columns, counts, extra


def packed(parts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    return batches.compressed(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts))


def unpacked(blob: bytes) -> list[bytes]:
    blob = batches.restored(blob)
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at = 4 + 4 * n + np.append(0, np.cumsum(np.frombuffer(blob, np.uint32, n, 4), dtype=np.int64))
    return [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer``: path of a byte-level BPE file of the ``tokenizers`` library, read once by the
    driver. No begin, end or padding tokens; special strings inside a text count one token each, as
    by the library's default. A null text counts as empty (0 bytes, 0 tokens); null and repeated ids and
    repeated rows give one result row each; other columns are ignored.
    """
    model = Path(tokenizer).read_text(encoding="utf-8")
    added = library(model).get_added_tokens_decoder().values()
    special = tuple(sorted((t.content for t in added), key=len, reverse=True))
    dealt = batches.batched(docs, doc_id, text)
    n_buckets = dealt.buckets(PRETOKENS_PER_BYTE)

    def send(table: pa.Table) -> pa.Table:
        raw = [p.encode() for p in distinct_pretokens(words.texts_of(table.column("text")), special, model)]
        order, met, bounds = batches.dealt(words.hashes_of(raw), n_buckets)
        blobs = [packed([raw[i] for i in order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
        batch = np.full(len(met), batches.int_at(table, "batch"))
        return pa.table({"batch": pa.array(batch, pa.int32()), "bucket": pa.array(met, pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = library(model).encode_batch
        asked = [unpacked(b) for b in table.column("payload").to_pylist()]
        distinct = list(dict.fromkeys(p for parts in asked for p in parts))
        pieces: dict[bytes, int] = {}
        for at in range(0, len(distinct), 5_000):
            some = distinct[at : at + 5_000]
            pieces.update(zip(some, (len(e) for e in encode([p.decode() for p in some], add_special_tokens=False))))
        given = [batches.compressed(np.array([pieces[p] for p in parts], np.uint32).tobytes()) for parts in asked]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": pa.array(given, pa.binary())})

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = words.texts_of(left.column("text"))
        distinct, rows, columns, counts, extra = frequencies(texts, special, model)
        pieces = batches.answers(right, words.hashes_of([p.encode() for p in distinct]), n_buckets, np.uint32, batches.restored)
        running = np.append(0, np.cumsum(pieces[columns].astype(np.int64) * counts))
        ends = np.cumsum(rows)
        n = running[ends] - running[ends - rows] + extra
        return pa.table(
            {
                "doc_id": left.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array(n > limit),
            }
        )

    by_batch = dealt.docs.groupBy("batch")
    counted = by_batch.applyInArrow(send, batches.ASK).groupBy("bucket").applyInArrow(count, batches.ANSWER)
    return by_batch.cogroup(counted.groupBy("batch")).applyInArrow(add, OUT)
