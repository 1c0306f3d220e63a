"""A batch is read more than once, and a shuffle gives its rows in any order each time."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import token_counts
from tidemill.llm.lm_scoring import Model, lm_scores, tokens
from tidemill.llm.queries import tokenizer_path


def made_rows(n=120):
    rng = random.Random(11)
    known = [f"Word{k}" for k in range(400)] + ["it's", "漢字", "<|endoftext|>", "12", "  "]
    return [(i // 2, " ".join(rng.choice(known) for _ in range(rng.randrange(60)))) for i in range(n)] + [(3, None), (None, "Word1 alone"), (4, "")]


@pytest.fixture
def any_order(spark):
    """The rows in another order whenever they are read, and no exchange used twice."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    docs = spark.createDataFrame(made_rows(), "doc_id bigint, text string").coalesce(1)

    def deal(batches):
        table = pa.Table.from_batches(list(batches))
        yield from table.take(pa.array(np.random.default_rng().permutation(table.num_rows))).combine_chunks().to_batches()

    yield docs.mapInArrow(deal, docs.schema)
    spark.conf.set("spark.sql.exchange.reuse", before)


def test_distinct_keys_do_not_follow_the_order_of_texts():
    texts = [(t or "").encode() for _, t in made_rows()]
    numbers, bounds, hashes = tokens(texts)
    back_numbers, _, back = tokens(texts[::-1])
    assert (hashes == back).all() and (np.bincount(numbers) == np.bincount(back_numbers)).all()
    first = hashes[numbers[bounds[0] : bounds[1]]]
    assert (first == back[back_numbers[len(back_numbers) - len(first) :]]).all()

    of = lambda x: token_counts.frequencies(x, ("<|endoftext|>",), "")
    plain = [t for t in texts if t.isascii()]
    distinct, rows, columns, counts, _ = of(plain)
    assert distinct == of(plain[::-1])[0] == sorted(distinct)
    for i, t in enumerate(plain):
        at = slice(rows[:i].sum(), rows[: i + 1].sum())
        want = Counter(p for part in t.decode().split("<|endoftext|>") for p in token_counts.regex.findall(token_counts.PATTERN, part))
        assert want == {distinct[c]: n for c, n in zip(columns[at], counts[at])}


def test_lm_scores_in_any_order(any_order):
    rows = made_rows()
    want = brute.unigram(rows)
    got = lm_scores(any_order, model=Model(bits=1 << 22)).collect()
    by_value = lambda rows: sorted((repr(r[0]), *r[1:5], round(r[5], 6)) for r in rows)
    assert len(got) == len(rows)
    assert {*by_value(got)} == {*by_value([(k[0], *v) for k, v in want.items()])}


def test_token_counts_in_any_order(any_order):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = made_rows()
    got = token_counts.token_counts(any_order, path).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
