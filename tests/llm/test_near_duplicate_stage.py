"""The near-duplicate stage decides row by row."""

import random
from collections import Counter

import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    twice, shared, nameless, near, own = (prose() for _ in range(5))
    rows = [(1, twice), (1, twice), (2, shared), (None, shared), (None, shared), (None, nameless), (None, nameless), (None, nameless)]
    rows += [(3, near), (None, near + " more"), (4, own), (4, prose()), (None, prose()), (5, None), (5, None), (None, " "), (None, "")]
    full = [(i, t, "en", f"s{k % 2}", k % 3) for k, (i, t) in enumerate(rows)]
    full += full[:2]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    want = Counter([(1, twice), (2, shared), (None, nameless), (3, near), *((i, t) for i, t in rows[10:])])
    assert got == want
