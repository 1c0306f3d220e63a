"""URL filter: all glob rules at once as one bit-parallel automaton over canonical URLs.

Each rule is a chain of states, one bit each, packed into 64-bit words (Shift-And; a ``*``
is a self-loop on its state). A step shifts the state words of all URLs of a batch, with carries, and masks
them by the characters at that place, so the cost per character is that of the words, not of the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between host and path in a canonical URL; no part of a URL matches it but the rule's own.
BORDER = "\x00"
CELLS = 4 << 20  # characters of URLs stepped through together
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict where no host and path rule fits: globs over host and path, block if one fits.
BLOCK_GLOBS = (
    "*casino*", "*cheap-pills*", "*spam-farm*", "*poker*", "*xxx*", "*free-download*", "*.exe", "*/wp-login*", "*/adserver/*", "*viagra*",
)


@dataclass(frozen=True)
class Rule:
    """``globs`` are matched against host, BORDER and path; ``name`` and ``verdict`` are reported."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    rank: int


def host_path_rules(rules=FIXED_RULES) -> list[Rule]:
    """A rule fits its host and all subdomains where the path starts with the rule's; the longest name wins."""
    return [Rule(h + p, v, (f"{h}{BORDER}{p}*", f"*.{h}{BORDER}{p}*"), len(h + p)) for h, p, v in rules]


def glob_rules(globs=BLOCK_GLOBS, verdict: str = "block") -> list[Rule]:
    """Globs over the whole URL, tried where no host and path rule fits; ``*`` crosses the border here."""
    return [Rule("", verdict, (g,), -1) for g in globs]


class Automaton:
    """Masks of all globs: ``enter[c]`` states reached on c from the state before, ``stay[c]`` self-loops."""

    def __init__(self, rules: list[Rule]):
        start, final, self.owner = [], [], []
        enter: list[tuple[int, bytes]] = []
        loops: list[tuple[int, bool]] = []
        bit = 0
        for i, rule in enumerate(rules):
            for glob in rule.globs:
                inside_host = BORDER in glob
                start.append(bit)
                for c in glob.encode():
                    if c == 42:  # "*"
                        loops.append((bit, inside_host))
                    else:
                        bit += 1
                        enter.append((bit, bytes([c])))
                        inside_host &= c != 0
                final.append(bit)
                self.owner.append(i)
                bit += 1
        self.words = bit // 64 + 1
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = final
        one = lambda b: (b // 64, np.uint64(1) << np.uint64(b % 64))
        for b in start:
            self.start[one(b)[0]] |= one(b)[1]
        for b, c in enter:
            self.enter[c[0], one(b)[0]] |= one(b)[1]
        for b, host_only in loops:
            w, m = one(b)
            self.stay[:, w] |= m
            if host_only:  # this star ends at the border
                self.stay[0, w] &= ~m

    def run(self, urls: list[bytes]) -> np.ndarray:
        """For each URL and glob: does the whole URL match?"""
        sizes = np.array([len(u) for u in urls])
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros((len(urls), len(self.final)), bool)
        at = 0
        while at < len(order):
            longest = max(1, int(sizes[order[at]]))
            some = order[at : at + max(1, CELLS // longest)]
            at += len(some)
            out[some] = self._run([urls[i] for i in some], sizes[some])
        return out

    def _run(self, urls: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """URLs from long to short, so that those not yet ended are a prefix."""
        width = max(1, int(sizes[0]))
        text = np.frombuffer(b"".join(u.ljust(width, b"\x01") for u in urls), np.uint8).reshape(len(urls), width)
        state = np.repeat(self.start[None, :], len(urls), 0)
        alive = np.searchsorted(-sizes, -np.arange(width), side="left")
        for k in range(width):
            n = int(alive[k])
            now, c = state[:n], text[:n, k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.enter[c]) | (now & self.stay[c])
        bits = [(state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) for b in self.final]
        return np.array(bits, bool).T


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    The fitting rule of the longest name wins (ties: the first given); without one, a fitting glob rule
    decides; without any, the verdict is allow. A null or relative URL has empty host and path and is allowed;
    repeated rows and null ids give one result row each; other columns are ignored. Only the
    URL column is read; no shuffle.
    """
    rules = host_path_rules() + glob_rules() if rules is None else rules
    automaton = Automaton(rules)
    ranks = np.array([rules[i].rank * len(rules) - i for i in automaton.owner])

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            host, path = (t.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
            # a NUL inside a URL is no border
            clean = [h.replace(b"\x00", b"\x01") + b"\x00" + p.replace(b"\x00", b"\x01") for h, p in zip(host, path)]
            hits = automaton.run(clean) if clean else np.zeros((0, len(ranks)), bool)
            best = np.where(hits, ranks[None, :], np.iinfo(np.int64).min).argmax(1) if len(hits) else []
            found = [rules[automaton.owner[b]] if hits[i, b] else None for i, b in enumerate(best)]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": t.column("page_id"), "host": t.column("host"), "path": t.column("path"),
                    "rule": pa.array([r.name or None if r else None for r in found], pa.string()),
                    "verdict": pa.array([r.verdict if r else "allow" for r in found], pa.string()),
                }
            )

    cut = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"))
    cut = cut.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return cut.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")
