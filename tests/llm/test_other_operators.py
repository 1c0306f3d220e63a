import math
import random
import re

import brute
import numpy as np

from tidemill.llm import embedding_dedup
from tidemill.llm.components import components
from tidemill.llm.mixing import Mix, mixed_sources, mixture
from tidemill.llm.quality_classifier import Settings, kth_largest, quality_classifier, quality_filter
from tidemill.llm.url_filter import BLOCK_GLOBS, FIXED_RULES, Rule, url_filter

SMALL = Settings(buckets=1 << 12, pseudo=5.0)


def labelled_corpus(spark, n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(80)]
        if i % 5 == 0:
            for k in range(6):
                w[rng.randrange(80)] = f"nasty{k % 3}"
        rows.append((i, " ".join(w), "x"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, n, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled_corpus(spark)
    got = {r.doc_id: r.kept for r in quality_classifier(docs, labels, SMALL).collect()}
    unseen = [i for i in got if i % 2]
    assert sum(not got[i] for i in unseen if i % 5 == 0) >= 0.95 * sum(i % 5 == 0 for i in unseen)
    assert sum(got[i] for i in unseen if i % 5) >= 0.97 * sum(i % 5 > 0 for i in unseen)
    kept = quality_filter(docs, labels, SMALL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_classifier_edge_cases(spark, docs, no_docs, rows):
    none = spark.createDataFrame([(None, 1, 0), (4, None, None), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier(docs, none, SMALL).collect()
    assert len(got) == len(rows) and all(r.kept and r.weight == 1.0 for r in got)
    assert quality_classifier(no_docs, none, SMALL).collect() == []
    assert quality_filter(no_docs, none, SMALL).collect() == []


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1e3) for _ in range(500)] + [7.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 3, 250, 519, 520):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 0) == math.inf and kth_largest(df, "x", 9_999) == min(values)


def brute_links(rows, threshold):
    links = {k: set() for k in range(len(rows))}
    for a, (_, v, x) in enumerate(rows):
        for b in range(a):
            _, w, y = rows[b]
            if x is None or x != y or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            v1, w1 = np.array(v, float), np.array(w, float)
            if not (np.isfinite(v1).all() and np.isfinite(w1).all() and v1.any() and w1.any()):
                continue
            if (v1 * w1).sum() / (np.sqrt((v1 * v1).sum()) * np.sqrt((w1 * w1).sum())) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(0)
    rows = []
    for k in range(150):
        base = rows[rng.integers(len(rows))][1] if k % 3 and rows else rng.normal(size=12).tolist()
        v = (np.array(base) + rng.normal(size=12) * rng.choice([0, 0.02, 0.06, 0.1])).astype(np.float32).tolist()
        rows.append((k, v, int(rng.integers(3))))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 12, 1), (203, [float("nan")] + [1.0] * 11, 1), (204, [None] + [1.0] * 11, 1)]
    rows += [(205, rows[0][1], None), (206, rows[0][1], rows[0][2]), (207, [float("inf")] + [1.0] * 11, 0), (208, [1.0, 0.0], 0), (209, [2.0, -0.0], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, class string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    links = brute_links(rows, 0.98)
    groups = brute.Sets(range(len(rows)))
    for a, own in links.items():
        for b in own:
            groups.join(a, b)
    want = {r[0]: (len(links[k]), rows[groups.find(k)][0], groups.find(k) == k) for k, r in enumerate(rows)}
    assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []


def test_int8_bound_never_misses(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=x.shape) * 0.2
    i, j = embedding_dedup.similar(x, y, 0.98)
    cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    near = np.abs(cosine - 0.98) < 1e-12
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(a.tolist() for a in np.nonzero((cosine >= 0.98) & ~near)))}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 3), (5, 5)]
    groups = brute.Sets({x for p in links if None not in p for x in p})
    for a, b in links:
        if a is not None:
            groups.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    met = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: groups.find(x) for x in met}


def brute_url(url):
    url = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(h + p, v) for h, p, v in FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0]))
    hit = any(re.fullmatch("(?s)" + ".*".join(map(re.escape, g.split("*"))), host + "\x01" + path) for g in BLOCK_GLOBS)
    return host, path, None, "block" if hit else "allow"


def test_urls_equal_brute_force(spark):
    urls = [
        None, "", "example.net/en/", "http://EXAMPLE.net/en/x", "https://a.b.example.net/de/1", "x://net/", "x://net", "ftp://notnet/", "http://x.org/fr/?q",
        "http://casino.com/a", "http://a.com/casino#x", "http://a.com/?casino", "http://example.com/x.net/y", "http://a.com/b://net/", "http://sub.example.com/de/",
        "http://a.com/prog.exe", "http://" + "a" * 5000 + ".net/" + "é" * 3000, "http://h\x00.net/\x00/", "http://h/*", "http:///en/", "http://a\nb.net/", "HTTP://WWW.ÀB.ORG/fr/",
    ]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(None, urls[3], "h", "p")], "page_id bigint, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()}
    assert got.pop(None) == brute_url(urls[3])
    assert got == {k: brute_url(u) for k, u in enumerate(urls)}
    assert url_filter(df.limit(0)).collect() == []


def test_many_globs_cross_word_borders(spark):
    rng = random.Random(6)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rules = [Rule(f"r{k}", "block", (g,), k) for k, g in enumerate(globs)]
    hosts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    df = spark.createDataFrame([(k, f"x://{h}") for k, h in enumerate(hosts)], "page_id bigint, url string")
    got = {r.page_id: r.rule for r in url_filter(df, rules).collect()}
    for k, h in enumerate(hosts):
        fits = [j for j, g in enumerate(globs) if re.fullmatch("(?s)" + ".*".join(map(re.escape, g.split("*"))), h + "\x00")]
        assert got[k] == (f"r{max(fits)}" if fits else None)


def test_mixing_meets_its_targets(spark, docs, rows, no_docs):
    sizes = {"a": 400, "b": 100, "c": 20, None: 5}
    table = [(len(sizes) * k + j, "w " * (3 + k % 7), s) for j, (s, n) in enumerate(sizes.items()) for k in range(n)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, source string")
    got = mixed_sources(df, Mix(max_repeats=3.0, block_docs=16)).collect()
    assert len(got) == len(table) and all(r.copies >= 1 for r in got)
    own = {}
    for r in got:
        own.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].weight for x in own.values()) - 1) < 1e-9
    assert max(x[0].repeats for x in own.values()) <= 3 + 1e-4 and min(x[0].repeats for x in own.values()) > 1 - 1e-9
    for x in own.values():  # the budget is met to one document
        total, mixed = sum(r.n_tokens for r in x), sum(r.n_tokens * r.copies for r in x)
        assert 0 <= x[0].repeats * total - mixed + 1e-3 <= max(r.n_tokens for r in x) + 1
    tokens = {s: sum(r.n_tokens for r in x) for s, x in own.items()}
    entropy = lambda p: -sum(q * math.log(q) for q in p)
    shares = [n / sum(tokens.values()) for n in tokens.values()]
    loose = {r.source: r.weight for r in mixed_sources(df, Mix(max_repeats=1e9)).collect()}
    assert abs(entropy(loose.values()) - (entropy(shares) + math.log(4)) / 2) < 1e-4
    few = mixed_sources(df, Mix(budget=500, entropy=0.0)).collect()
    assert 480 <= sum(r.n_tokens * r.copies for r in few) <= 500
    assert len(mixed_sources(docs).collect()) == len(rows)
    assert mixed_sources(no_docs).collect() == []


def test_mixture_repeats_whole_rows(docs, rows):
    times = {(r.doc_id, r.n_tokens): r.copies for r in mixed_sources(docs.where("doc_id is not null")).collect()}
    out = mixture(docs.where("doc_id is not null"))
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: c for (i, _), c in times.items()}


def test_mixing_plans_no_python(docs):
    plan = mixed_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_rules_plan_no_python_no_shuffle(docs):
    from tidemill.llm.quality_rules import quality_rules

    plan = quality_rules(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange") <= docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
