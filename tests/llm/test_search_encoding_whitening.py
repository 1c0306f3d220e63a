import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemill.llm import lexical_search
from tidemill.llm.bidiagonal import bidiagonalised, dqds, leading
from tidemill.llm.lexical_search import ranked_search
from tidemill.llm.merge_encoding import Decoder, Encoder, load_model, sentencepiece_decode, sentencepiece_encode
from tidemill.llm.whitening import embedding_whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# -- encoding ----------------------------------------------------------------


def test_encoder_equals_the_library_on_spaces_junk_and_long_runs(library):
    model, rng = load_model(MODEL), random.Random(5)
    own, back = Encoder(model), Decoder(model)
    texts = [" " * n + tail for n in range(70) for tail in ("", "x", "5", "\n  the", "☃")]
    pools = [" abcdefthingoer", "  \n\t▁éüñçаяжлん中文日😀\x00<>s0x41/unk“ﬁ", "et", "0123456789abcdef", "́e "]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["a" * 20_000, "th" * 5000 + "e" * 5000, "中" * 5000, "".join(rng.choice("abcdefXYZ0189+/") for _ in range(20_000))]
    for t in texts:
        ids = list(own.encode(t))
        assert ids == library.encode(t), t[:60]
        assert back.decode(ids) == library.decode(ids), t[:60]


def test_decoder_equals_the_library_on_any_ids(library):
    back, rng = Decoder(load_model(MODEL)), random.Random(6)
    for _ in range(5000):
        ids = [rng.randrange(32_000 if rng.random() < 0.4 else 262) for _ in range(rng.randrange(12))]
        assert back.decode(ids) == library.decode(ids), ids
    with pytest.raises(IndexError):
        back.decode([32_000])


def test_tables_are_encoded_and_decoded(docs, no_docs, rows, library):
    clashing = docs.withColumn("ids", F.lit("no")).withColumn("n_tokens", F.lit("no"))
    out = sentencepiece_decode(sentencepiece_encode(clashing, MODEL), MODEL)
    assert {"source", "batch", "bucket"} < {*out.columns}
    got = sorted((r.doc_id or -1, tuple(r.ids), r.n_tokens, r.decoded) for r in out.collect())
    want = sorted((i or -1, tuple(library.encode(t or "")), len(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert got == want
    assert sentencepiece_decode(sentencepiece_encode(no_docs, MODEL), MODEL).collect() == []


def test_null_ids_decode_to_an_empty_text(spark, library):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 450, None])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in sentencepiece_decode(df, MODEL).collect()} == {1: "", 2: "", 3: library.decode([450])}


# -- ranked search -----------------------------------------------------------


def plain_search(docs, items, k):
    """[(item_id, rank, doc_id, score)]"""
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(small))
    terms = [split(t) for _, t in docs]
    n_docs, n_terms = sum(1 for t in terms if t), sum(map(len, terms))
    df = {}
    for own in terms:
        for t in {*own}:
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), own in zip(docs, terms):
            m = 100 - 75 + (75 * len(own) * n_docs) // max(n_terms, 1)
            score = 0
            for t in split(text):
                if tf := own.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def items_of(rows):
    words = [t.split() for _, t in rows if t and len(t.split()) > 12]
    items = [(k, " ".join(w[3:12])) for k, w in enumerate(words[:25])]
    items += [(100, None), (101, ""), (102, "nowhere to be found"), (103, "WORD word, Word"), (None, words[0][0]), (7, items[7][1]), (104, "ünï w1")]
    return items


@pytest.mark.parametrize(("owners", "items_a_bundle", "docs_a_block"), [(4, 256, 2048), (1, 256, 2048), (3, 7, 8)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, owners, items_a_bundle, docs_a_block):
    monkeypatch.setattr(lexical_search, "BUNDLE_ITEMS", items_a_bundle)
    small = [(i, t) for i, t in rows if len(t or "") < 20_000]
    items = items_of(small)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, digest string, rank int").repartition(3)
    few = docs.where(F.coalesce(F.length("text") < 20_000, F.lit(True)))
    lexical_search.BLOCK_DOCS, before = docs_a_block, lexical_search.BLOCK_DOCS
    try:
        got = sorted(map(tuple, ranked_search(few, asked, k=3, owners=owners).collect()), key=repr)
    finally:
        lexical_search.BLOCK_DOCS = before
    assert got == plain_search(small, items, 3)


def test_pairs_dropped_on_the_way_are_never_among_the_best(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(1500)]
    items = [(k, " ".join(word() for _ in range(12))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = ranked_search(docs, spark.createDataFrame(items, "item_id bigint, text string"), k=10, owners=6)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, items, 10)


def test_search_without_documents_or_items(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "word"), (2, None)], "item_id bigint, text string")
    assert ranked_search(no_docs, items).collect() == []
    assert ranked_search(docs, items.where("item_id = 2")).collect() == []


# -- whitening ---------------------------------------------------------------


def test_singular_values_and_vectors_of_small_matrices():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 40):
        turn = lambda: np.linalg.qr(rng.normal(size=(d, d)))[0]
        level = np.r_[np.full(d // 2, 5.0), np.ones(d - d // 2)]
        kinds = [rng.normal(size=(d, d)), 3 * np.eye(d), np.zeros((d, d)), np.ones((d, d)), turn() @ np.diag(level) @ turn()]
        kinds.append(np.triu(rng.normal(size=(d, d))) * np.logspace(0, -8, d))
        for m in kinds:
            want = np.linalg.svd(m)[1] ** 2
            a, b, _ = bidiagonalised(m)
            size = max(want[0], 1e-300)
            assert np.abs(dqds(a * a, b * b) - want).max() <= 1e-13 * size
            values, vectors = leading(m, 4)
            assert np.abs(values - want[:4]).max() <= 1e-13 * size
            assert np.abs(m.T @ m @ vectors.T - vectors.T * values).max() <= 1e-12 * size
            assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(fit))
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    deviation = ((len(fit) * x - fit.sum(0)) ** 2).sum(1)
    return len(fit), deviation, ((x - fit.mean(0)) @ directions) / np.sqrt(values), values / centred.var(0).sum()


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(3000, 12)) * np.linspace(1, 0.2, 12) + rng.normal(size=12)).tolist()
    good += good[:700] + [good[0]] * 1500  # a third of all rows is one vector
    rows = [(i, v, "x", 1) for i, v in enumerate(good)]
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5]
    rows += [(10_000 + i, v, "x", 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, component int").repartition(7)
    got = {}
    for r in embedding_whitening(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == list(range(len(good)))
    n, deviation, whitened, explained = plain_whitening(good)
    for i, own in got.items():
        assert sorted(own) == [1, 2, 3, 4]
        for c, r in own.items():
            assert (r.n, r.deviation) == (n, deviation[i]) and r.identity_error < 1e-12
            assert abs(r.explained - explained[c - 1]) < 1e-12
    mine = np.array([[got[i][c].whitened for c in (1, 2, 3, 4)] for i in range(len(good))])
    sign = np.sign((mine * whitened).sum(0))
    assert np.abs(mine - sign * whitened).max() < 1e-10


def test_whitening_of_little_or_nothing(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embedding_whitening(spark.createDataFrame([], schema)).collect() == []
    assert embedding_whitening(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).collect() == []
    one = embedding_whitening(spark.createDataFrame([(1, [0.5, 0.25], 1), (None, [0.5, 0.25], 1)], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = embedding_whitening(spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(5)], schema)).collect()
    assert {r.component: r.explained for r in line} == {1: 1.0, 2: 0.0}
    assert all(r.whitened is None for r in line if r.component == 2)
    assert sorted(round(abs(r.whitened), 6) for r in line if r.component == 1) == [0.0, 0.707107, 0.707107, 1.414214, 1.414214]


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e15, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 1.0])]
    out = embedding_whitening(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("component = 1").collect()
    assert all(r.deviation is None for r in out if r.vec_id == 1) and len(out) == 3
