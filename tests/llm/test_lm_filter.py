"""Scores of the bigram model against brute force, with a filter in few and in many parts."""

import random
from collections import Counter
from math import fsum, log10

import brute
import pytest
from pyspark.sql import functions as F

from tidemill.llm.lm_scoring import Model, lm_scores

SHARP = {"bits_per_entry": 128, "probes": 8}  # no false positive on small inputs


def brute_scores(rows, held, share=0.2):
    """{doc_id: score} with counts of pairs held to the power of two below."""
    tokens = {i: [x.lower() for x in brute.words(t)] + [None] for i, t in rows}
    learned = [w for i, w in tokens.items() if i not in held]
    one = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip([None, *w], w))
    n, v = sum(one.values()), len(one)

    def p(a, b):
        c = two[a, b]
        pair = min(2 ** (c.bit_length() - 1), one[a]) / max(one[a], 1) if c else 0.0
        return share * pair + (1 - share) * (one[b] + 0.5) / (n + 0.5 * (v + 1))

    return {i: fsum(log10(p(a, b)) for a, b in zip([None, *w], w)) for i, w in tokens.items()}


@pytest.fixture(scope="module")
def some():
    rng = random.Random(12)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(150, None)]


@pytest.mark.parametrize("bits", [1 << 28, 1 << 12])
def test_scores_equal_brute_force(spark, some, bits):
    """Pairs seen once count as well; small ``bits`` split the filter into more parts."""
    df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_scores(df, F.col("doc_id") % 4 == 0, Model(bits=bits, **SHARP)).collect()}
    want = brute_scores(some, {i for i, _ in some if i % 4 == 0})
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_a_larger_corpus_gets_a_larger_filter(spark):
    """With more pairs than a filter of ``bits`` could tell apart, unseen pairs still score as unseen."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(2000)}"
    rows = [(i, " ".join(word() for _ in range(2000))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = F.col("doc_id") % 5 == 0
    got = {r.doc_id: r.score for r in lm_scores(df, held, Model(bits=1 << 20)).collect()}
    want = brute_scores(rows, {i for i, _ in rows if i % 5 == 0})
    for i in range(0, 200, 5):
        assert got[i] == pytest.approx(want[i], rel=2e-3)
