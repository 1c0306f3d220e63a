"""Exact encoding by a SentencePiece merge model, and its decoding.

The library merges the best-scored adjacent pair, the leftmost of equals, until none is left. The same ids come
from the front: a text's encoding is the one run of pieces in which every two neighbours, merged
anew on their own, stay these two. So a scan takes the longest piece that fits at a place (all matches from one
Aho-Corasick pass), checks it against the piece before by merging both again, goes to shorter ones, and steps back
where none fits; a bit per place keeps a failed place from being tried twice. Work is linear in
the text also where no space parts it.

No piece holds a space after another character, so a text falls into runs of spaces with the word that
follows; equal runs are encoded once per task as long as the table of them is small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import batches

SPACE = "▁"
KNOWN_RUNS, KNOWN_PAIRS, LONGEST_KEPT = 400_000, 500_000, 64
NEVER, START = float("-inf"), (1 << 22) - 1
ENCODED = "ids array<int>, n_tokens bigint"


@dataclass(frozen=True)
class MergeModel:
    """Pieces by id with their scores; ``kinds`` has one letter each: n(ormal), b(yte), c(ontrol), u(nknown)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    unknown: str
    dummy_prefix: bool


def load_model(path: str) -> MergeModel:
    """Reads a model file. Raises for models of another kind: no merges, no byte pieces, a character map, own symbols."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    form, train, letters = model.normalizer_spec, model.trainer_spec, {1: "n", 2: "u", 3: "c", 6: "b"}
    if train.model_type != formats.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a merge model with byte pieces")
    if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError(f"{path}: texts would be changed before they are encoded")
    if any(p.type not in letters for p in model.pieces):
        raise ValueError(f"{path}: unused or user-defined pieces")
    return MergeModel(
        tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), "".join(letters[p.type] for p in model.pieces),
        train.unk_surface, form.add_dummy_prefix,
    )


class Encoder:
    def __init__(self, model: MergeModel):
        normal = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == "n"]
        self.id_of = dict(normal)
        self.score_of = {p: model.scores[i] for p, i in normal}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == "b"}
        self.prefix = SPACE if model.dummy_prefix else ""
        parted = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.run = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if parted else "(?s).+")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) > 1:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pieces, self.length = model.pieces, [len(p) for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.runs = Known(self.run_ids)

    def apart(self, a: str, b: str) -> bool:
        """Merges ``a + b`` from its characters: do exactly ``a`` and ``b`` come out (``b`` alone where ``a`` is empty)?"""
        parts, score, seam = list(a + b), self.score_of.get, len(a) - 1
        found = [score(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while found and (best := max(found)) != NEVER:
            at = found.index(best)
            if at == seam:
                return False
            seam -= at < seam
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], NEVER)
        return len(parts) == 1 + (a != "")

    def spelled(self, i: int) -> str:
        return "" if i == START else self.pieces[i] if i < len(self.pieces) else chr(i - len(self.pieces))

    def split(self, text: str) -> list[int]:
        """The pieces of ``text`` by id; a character without a piece stands for itself, its code point behind the ids."""
        other, length = len(self.pieces), self.length
        one = [i if (i := self.id_of.get(c)) is not None else other + ord(c) for c in text]
        longer: list[list[int] | None] = [None] * len(text)
        for end, i in self.automaton.iter(text):  # by end, so the longest at a place comes last
            start = end + 1 - length[i]
            if longer[start] is None:
                longer[start] = [one[start], i]
            else:
                longer[start].append(i)
        pairs, failed, any_failed = self.pairs, bytearray(len(text) // 8 + 1), False
        pieces: list[int] = []
        tried: list[int] = []  # the match taken at each piece's place; shorter ones are left
        at, before = 0, START
        here = longer[0] or one[:1]
        k = len(here)
        while True:
            while k:
                k -= 1
                piece = here[k]
                end = at + (length[piece] if k else 1)
                if any_failed and failed[end >> 3] >> (end & 7) & 1:
                    continue
                pair = before << 22 | piece
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= KNOWN_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.apart(self.spelled(before), self.spelled(piece))
                if fits:
                    pieces.append(piece)
                    if end == len(text):
                        return pieces
                    tried.append(k)
                    at, before = end, piece
                    here = longer[at] or one[at : at + 1]
                    k = len(here)
                    break
            else:
                if not pieces:
                    raise ValueError("the model's merges do not cover this text")
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                k = tried.pop()
                gone = pieces.pop()
                at -= length[gone] if gone < other else 1
                before = pieces[-1] if pieces else START
                here = longer[at] or one[at : at + 1]

    def run_ids(self, run: str) -> tuple[int, ...]:
        ids, other = self.split(run), len(self.pieces)
        if max(ids) < other:
            return tuple(ids)
        return tuple(chain.from_iterable([i] if i < other else map(self.byte_id.__getitem__, chr(i - other).encode()) for i in ids))

    def encode(self, text: str) -> Iterator[int]:
        if not text:
            return iter(())
        return chain.from_iterable(map(self.runs.__getitem__, self.run.findall(self.prefix + text.replace(" ", SPACE))))


class Known(dict):
    """Ids of runs, found once. When half full it begins anew and takes over what is met again; long runs are not kept."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = self.older.get(run)
        if ids is None:
            ids = self.find(run)
        if len(run) <= LONGEST_KEPT:
            if 2 * len(self) >= KNOWN_RUNS:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids


#: Well-formed UTF-8 sequences; what lies between them is broken byte by byte.
CHARACTER = re.compile(
    rb"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}|(?s:.)"
)


def spelled(raw: bytes) -> str:
    """Bytes as characters; every byte outside a well-formed sequence becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join("�" if len(c) == 1 and c >= b"\x80" else c.decode() for c in CHARACTER.findall(raw))


class Decoder:
    def __init__(self, model: MergeModel):
        shown = {"n": lambda p: p.replace(SPACE, " "), "c": lambda p: "", "u": lambda p: model.unknown, "b": lambda p: ""}
        self.shown = [shown[k](p) for p, k in zip(model.pieces, model.kinds)]
        self.byte = {i: int(p[1:-1], 16) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == "b"}
        self.strip = model.dummy_prefix
        self.starts = {i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == "n" and p.startswith(SPACE)}
        self.silent = {i for i, k in enumerate(model.kinds) if k == "c"}

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the space the encoder puts in front goes, control pieces are silent."""
        if any(i < 0 for i in ids):
            raise IndexError("no piece has a negative id")
        first = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        if self.byte.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                b = self.byte.get(i)
                if b is None:
                    if raw:
                        parts.append(spelled(bytes(raw)))
                        raw.clear()
                    parts.append(self.shown[i])
                else:
                    raw.append(b)
            text = "".join([*parts, spelled(bytes(raw))])
        return text[1:] if self.strip and first < len(ids) and ids[first] in self.starts else text


@cache
def encoder(model: MergeModel) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(model)


@cache
def decoder(model: MergeModel) -> Decoder:
    return Decoder(model)


def _without(df: DataFrame, *names: str) -> list[str]:
    taken = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken]


def sentencepiece_encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text but with ids array<int> and n_tokens, exactly as the library's encode without options.

    No begin or end ids. A null text counts as empty (no ids); repeated rows and null ids of documents keep their rows;
    columns named ids or n_tokens are replaced, all others stay. The model file is read once, by the driver.
    """
    model = load_model(model_path)
    rows = docs.select(*_without(docs, text, "ids", "n_tokens"), F.col(f"`{text}`").alias(text))
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model).encode
        for table in tables:
            for part in batches.small_parts(table, text):
                lists = [np.fromiter(encode(t or ""), np.int32) for t in part.column(text).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), ids, pa.array(sizes)], names=[*(f.name for f in kept), "ids", "n_tokens"]
                )

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, own + ENCODED)


def sentencepiece_decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with the text of their ids in column ``out``, exactly as the library's decode(ids).

    Null or empty ids give an empty text, a null id inside counts as left out; an id outside the model fails the job, as in the library.
    Byte pieces that form no character become U+FFFD each. A column named as ``out`` is replaced, all others stay.
    """
    model = load_model(model_path)
    rows = encoded.select(*_without(encoded, out))
    kept = rows.schema.fields

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(model).decode
        for table in tables:
            column = table.column(ids)
            for at in range(0, table.num_rows, 256):
                part = column.slice(at, 256)
                flat = np.asarray(part.flatten().fill_null(-1)).astype(np.int64)
                bounds = np.append(0, np.cumsum(np.asarray(pc.list_value_length(part).fill_null(0)).astype(np.int64)))
                nulls = part.flatten().null_count > 0
                lists = (flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:]))
                texts = [decode([i for i in x if i >= 0] if nulls else x) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [*(table.column(f.name).slice(at, 256) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), out]
                )

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, own + f"`{out}` string")
