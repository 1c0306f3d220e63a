"""The pipeline over a small corpus, stage by stage against brute force."""

import random

import brute
import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    at = str(tmp_path_factory.mktemp("corpus"))
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage, base = prose(60), prose(200).split()
    rows = []
    for i in range(240):
        text = prose(rng.randrange(20, 160))
        if i % 6 == 0:
            text = " ".join(f"nasty{k % 4} {w}" if k % 9 == 0 else w for k, w in enumerate(text.split()))
        elif i % 17 == 1:
            text = f"{prose(25)}\n{passage}\n{prose(15)}"
        elif i % 11 == 1:
            own = list(base)
            own[rng.randrange(200)] = f"new{i}"
            text = " ".join(own)
        rows.append((i, text, "en", f"src{0 if i % 3 else i % 7}", len(text), "extra"))
    rows += [(300, None, None, None, None, "extra"), (301, "", "en", "src1", 0, "extra"), (302, rows[5][1], "en", "src2", 1, "extra")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 240, 2)] + [(i, 1, 0) for i in range(1, 60, 6)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_equal_brute_force(spark, folder, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "substring dedup", "source mixing", "best-fit packing"]
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
    for df in tables[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)
    texts = [{(r.doc_id, r.text) for r in df.collect()} for df in tables[:-1]]
    ids = {i for i, _ in texts[0]}
    assert sum(i % 6 == 0 for i in ids if i < 240) <= 2 and len([i for i in ids if i % 6]) >= 195
    components = brute.jaccard(sorted(texts[0], key=lambda x: x[0]), 5, 80)
    assert {i for i, _ in texts[1]} == {i for i, (_, c) in components.items() if i == c}
    removed = {i: (n, h) for i, _, n, h in brute.substring(list(texts[1]), 20)}
    before = dict(texts[1])
    assert {i for i, _ in texts[2]} == set(before)
    for i, t in texts[2]:
        n, _ = removed[i]
        assert t == before[i] if n == 0 else len(brute.words(t)) == len(brute.words(before[i])) - n
    assert texts[3] == texts[2]
    repeated = {}
    for r in tables[3].collect():
        repeated[r.doc_id] = repeated.get(r.doc_id, 0) + 1
    packed = {}
    for r in tables[4].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: repeated[i] * (len(brute.words(t)) + 1) for i, t in texts[3]}


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "bin_id", "bin_capacity"} <= {*got.columns} and got.count() > 0
