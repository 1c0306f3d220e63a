"""Words of a batch of texts as NumPy arrays; small helpers that run inside Spark tasks.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``: exactly what
``bytes.split()`` gives. Words of all texts of a batch lie one after the other;
``bounds[i]:bounds[i + 1]`` are those of text i.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def lower_ascii(texts: list[bytes]) -> list[bytes]:
    """``bytes.lower`` changes A-Z only."""
    return [t.lower() for t in texts]


def numbered(texts: list[bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers, bounds and the distinct words in order of their numbers.

    ``end``: a closing token for every text; pick one that no word can equal.
    """
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    number = known.__getitem__
    tail = [] if end is None else [number(end)]
    parts = [np.array([*map(number, t.split()), *tail], dtype=np.int32) for t in texts]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    known.default_factory = None  # it refers to the dict: all words would stay until Python looks for cycles
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), bounds, list(known)


def hashes_of(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the bounds."""
    numbers, bounds, distinct = numbered(texts)
    return (hashes_of(distinct, seed)[numbers] if len(numbers) else np.empty(0, np.uint64)), bounds


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(29))
    h = h * MIX_B
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, bounds: np.ndarray, width: int, factor: np.uint64 = MIX_A) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the places of their first words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= factor
        out += h[k : k + n]
    inside = np.zeros(len(h) + 1, np.int32)  # counts the texts with a window that may start here
    long = np.diff(bounds) >= width
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    return mixed(out[starts]), starts
