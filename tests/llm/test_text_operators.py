import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import jaccard_join, set_trie, token_counts
from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.lm_scoring import Model, lm_scores
from tidemill.llm.packing import Sizes, best_fit_packing, pack
from tidemill.llm.quality_rules import quality_rules
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.substring_dedup import substring_dedup


def digest(df):
    out = df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("window", [3, 20])
def test_substring_equals_brute_force(docs, rows, window):
    assert digest(substring_dedup(docs, window)) == brute.substring(rows, window)


def test_substring_repeated_rows_and_layout(spark, rows):
    text = rows[8][1]
    twice = spark.createDataFrame([(1, text), (1, text), (2, "a\n b"), (3, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, substring_dedup(twice, 20, keep_layout=True).select("doc_id", "n_removed", "kept_text").collect()))
    assert got == [(1, 0, text), (1, 0, text), (2, 0, "a\n b"), (3, 0, None)]


def test_jaccard_equals_brute_force(docs, rows):
    known = [(i, t) for i, t in rows if i is not None]
    for n, percent in ((3, 90), (5, 80), (1, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs.where("doc_id is not null"), n, percent).collect()}
        assert got == brute.jaccard(known, n, percent)


def test_jaccard_null_ids_and_repeated_rows(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (9, "x y z"), (None, None), (4, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in jaccard_components(df).collect()), key=repr)
    want = [(3, 4, 3, True), (3, 4, 3, True), (4, 0, 4, True), (9, 1, 9, True), (None, 0, None, True), (None, 4, 3, False)]
    assert got == sorted(want, key=repr)


def test_jaccard_blocks_of_large_groups(spark, monkeypatch):
    """A group of more sets than a block gives the same components."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(30):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute.jaccard(rows, 3, 90)


def test_trie_links_exactly_the_similar_sets():
    rng = random.Random(1)
    for percent in (50, 80, 90):
        sets = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 25)))) for _ in range(60)]
        sets += [np.array(sorted({*s.tolist()} ^ {rng.randrange(30)})) for s in sets if len(s) > 2]
        groups = brute.Sets(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len({*sets[i].tolist()} & {*sets[j].tolist()})
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    groups.join(i, j)
        found = brute.Sets(range(len(sets)))
        for i, j in set_trie.spanning_links(sets, percent):
            found.join(i, j)
        assert [groups.find(i) for i in range(len(sets))] == [found.find(i) for i in range(len(sets))]


def test_rules_equal_brute_force(docs, rows):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(((r.doc_id, *(r[c] for c in columns)) for r in quality_rules(docs).collect()), key=repr)
    assert got == sorted(((i, *brute.rules(t)) for i, t in rows), key=repr)


def test_rules_thresholds(spark):
    good = "the cat of the house and a dog in it was with one more for that by " * 2
    good += " ".join(f"und{k} le{k}" for k in range(30))
    texts = {1: good, 2: good.replace(" ", "### "), 3: " ".join(f"qq{k}" for k in range(80)), 4: "\n".join(["the of and to"] * 40 + [good])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert got[1].kept and not got[1].base_failed
    assert got[2].fails_symbols and not got[2].kept
    assert got[3].fails_stop_words and not got[3].kept
    assert got[4].fails_repeated_lines and not got[4].kept


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = [(200, "a <|endoftext|> b<|endoftext|>"), (201, "\u0558x \U00010940 ⁊ 漢字  \n\n  end "), (202, "it's we'll  \r\n\x85 1234")]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id bigint, text string"))
    got = sorted((tuple(r) for r in token_counts.token_counts(more, path, limit=100).collect()), key=repr)
    want = []
    for i, t in rows + extra:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)


def test_lm_scores_base_equals_brute_force(docs, rows):
    got = lm_scores(docs, model=Model(bits=1 << 22)).collect()
    want = sorted(brute.unigram(rows).items(), key=lambda x: (repr(x[0][0]), x[1][1]))
    got = sorted(got, key=lambda r: (repr(r.doc_id), r.n_tokens))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(k[0], *v[:4]) for k, v in want]
    for r, (_, v) in zip(got, want):
        assert abs(r.base_score - v[4]) < 1e-9 * abs(v[4])
        assert r.score < 0


def test_lm_scores_learn_word_pairs(spark):
    """Held-out text of known pairs gains; text of unknown pairs loses at most the share of the unigrams."""
    rng = random.Random(2)
    pairs = [(f"a{k}", f"b{k}") for k in range(50)]
    rows = [(i, " ".join(w for _ in range(40) for w in rng.choice(pairs))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = [r for r in lm_scores(df, model=Model(bits=1 << 22)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    shuffled = [(i, " ".join(rng.sample(t.split(), 80))) for i, t in rows]
    for r in lm_scores(spark.createDataFrame(shuffled, df.schema), model=Model(bits=1 << 22, bigram_share=0.0)).collect():
        assert abs(r.score - r.base_score) < 1e-6


def test_packing_keeps_every_token(docs, rows):
    sizes = Sizes((16, 64, 256))
    got = best_fit_packing(docs, sizes).collect()
    n = sorted(len(brute.words(t)) + 1 for _, t in rows)
    assert sum(r.length for r in got) == sum(n)
    by_doc = {}
    for r in got:
        assert 0 < r.length <= 256 and r.bin_used <= r.bin_capacity and r.position + r.length <= r.bin_used
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in rows:
        if i is not None:
            at = 0
            for start, length in sorted(by_doc[i]):
                assert start == at
                at += length
            assert at == len(brute.words(t)) + 1
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert sum(r.length for r in own) == own[0].bin_used
        assert own[0].bin_capacity == min(c for c in sizes.capacities if c >= own[0].bin_used)


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 4097, 4000)
    sizes = Sizes()
    bins, used = pack(lengths, sizes)
    assert np.bincount(bins, lengths).tolist() == used
    cost = sum(sizes.cost(sizes.cheapest(u)) for u in used)
    assert cost < 1.03 * lengths.sum() * min(sizes.cost(c) / c for c in sizes.capacities)


def test_empty_tables(no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    for df in (
        substring_dedup(no_docs), jaccard_components(no_docs), quality_rules(no_docs), token_counts.token_counts(no_docs, path),
        lm_scores(no_docs, model=Model(bits=1 << 20)), best_fit_packing(no_docs),
    ):
        assert df.collect() == []
