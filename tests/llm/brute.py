"""Plain Python versions of the operators, for small inputs."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations
from math import fsum, log10


def words(text):
    return (text or "").encode().split()


class Sets:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def substring(rows, window):
    """rows of (doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256)."""
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (place(i), s)), (place(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (place(i), s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, n):
    w = words((text or ""))
    w = [x.lower() for x in w]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(rows, n, percent):
    """rows of (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t, n) for i, t in rows}
    groups = Sets(sets)
    for i, j in combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def rules(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(windows)
    again = {j for k, x in enumerate(windows) if times[x] > 1 for j in (k, k + 1, k + 2)}
    n_symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), n_symbols, dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def unigram(rows):
    """rows of (doc_id, text) -> {(doc_id, text): (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = [(i, t, [x.lower() for x in words(t)] + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(x for i, _, w in tokens if not held(i) for x in w)
    n, v = sum(counts.values()), len(counts)
    return {
        (i, t): (held(i), len(w), sum(x in counts for x in w), n, fsum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        for i, t, w in tokens
    }
