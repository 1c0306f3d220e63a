"""Registered queries of the dealt operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.llm.embedding_dedup import embedding_dedup
from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.lexical_search import ranked_search
from tidemill.llm.lm_scoring import lm_scores
from tidemill.llm.merge_encoding import sentencepiece_decode, sentencepiece_encode
from tidemill.llm.mixing import mixed_sources
from tidemill.llm.packing import best_fit_packing
from tidemill.llm.quality_classifier import quality_classifier
from tidemill.llm.quality_rules import LIMITS, STOP_WORDS, quality_rules
from tidemill.llm.registry import ORACLE, QUERIES, query, table  # noqa: F401
from tidemill.llm.substring_dedup import substring_dedup
from tidemill.llm.token_counts import token_counts
from tidemill.llm.url_filter import BLOCK_GLOBS, FIXED_RULES, url_filter
from tidemill.llm.whitening import embedding_whitening

WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _op2_sql() -> str:
    metric = {
        "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
        "stop_word_share": "n_stop_words / n_words", "dup_line_share": "n_dup_lines / n_lines",
    }
    ratios = ", ".join(f"CASE WHEN {e.split(' / ')[1]} = 0 THEN 0.0 ELSE {e.split(' / ')[0]}::DOUBLE / {e.split(' / ')[1]}::DOUBLE END AS {m}" for m, e in metric.items())
    tests = {
        x.name: " OR ".join([f"{x.metric} < {x.low}"] * (x.low is not None) + [f"{x.metric} > {x.high}"] * (x.high is not None))
        for x in LIMITS
    }
    flags = ", ".join(f"({t}) AS fails_{n}" for n, t in tests.items())
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i+1], words[i+2]) AS n FROM p),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM m),
f AS (SELECT *, {flags} FROM r)
SELECT *, NOT (base_failed OR {' OR '.join('fails_' + n for n in tests)}) AS kept FROM f"""


@query("op2_quality_rules", _op2_sql())
def op2(spark, folder):
    """Counts and verdict of every document."""
    return quality_rules(table(spark, folder, "documents"))


@query("op8_token_counts")
def op8(spark, folder):
    """Tokens of every document by the public byte-level BPE."""
    return token_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def _op10_sql() -> str:
    fits = [
        (f"{h}{p}", v, len(h + p), f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for h, p, v in FIXED_RULES
    ]
    fits.sort(key=lambda x: -x[2])
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for n, _, _, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{n}' THEN '{v}'" for n, v, _, _ in fits)
    globs = " OR ".join("(host || chr(1) || path) LIKE '" + g.replace("_", "\\_").replace("%", "\\%").replace("*", "%") + "' ESCAPE '\\'" for g in BLOCK_GLOBS)
    return rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT *, {rule} AS rule FROM l)
SELECT page_id, host, path, rule, {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


@query("op10_url_filters", _op10_sql())
def op10(spark, folder):
    """Host and path rules, then globs, over every page's URL."""
    return url_filter(table(spark, folder, "pages"))


_OP1_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS passage FROM s),
f AS (SELECT doc_id, i, first_value(doc_id) OVER e AS d0, first_value(i) OVER e AS i0 FROM k WINDOW e AS (PARTITION BY passage ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE doc_id <> d0 OR i <> i0)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
c AS (SELECT p.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (WHERE g.j IS NULL) AS kept
      FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.j = p.j GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)"""


@query("op1_substring_dedup", _OP1_SQL)
def op1(spark, folder):
    """Words left of every document once passages of 20 words that occur earlier are gone."""
    kept = substring_dedup(table(spark, folder, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{WORD}') AS ws FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT a, b FROM k UNION SELECT r.id, k.b FROM r JOIN k ON r.other = k.a),
m AS (SELECT id, min(other) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id,
    w.doc_id = least(w.doc_id, coalesce(m.least, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id"""


@query("op9_ngram_jaccard_join", _OP9_SQL)
def op9(spark, folder):
    """Components of documents whose sets of 3-word shingles overlap by 0.9 or more."""
    return jaccard_components(table(spark, folder, "documents"), n=3, percent=90)


@query("op5_lm_scoring")
def op5(spark, folder):
    """Unigram and bigram scores of every document; a fifth of them is held out of training."""
    return lm_scores(table(spark, folder, "documents"))


_OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c(id, r) AS (SELECT a, b FROM k UNION SELECT c.id, k.b FROM c JOIN k ON c.r = k.a)
SELECT v.vec_id, (SELECT count(*) FROM k WHERE k.a = v.vec_id) AS n_links,
    least(v.vec_id, coalesce((SELECT min(r) FROM c WHERE c.id = v.vec_id), v.vec_id)) AS component_id,
    v.vec_id = least(v.vec_id, coalesce((SELECT min(r) FROM c WHERE c.id = v.vec_id), v.vec_id)) AS kept
FROM v"""


@query("op7_embedding_dedup", _OP7_SQL)
def op7(spark, folder):
    """Links, component and survivor of every vector at cosine 0.98 within its label."""
    return embedding_dedup(table(spark, folder, "embeddings"), threshold=0.98)


@query("op3_quality_classifier")
def op3(spark, folder):
    """Importance weight, Gumbel key and verdict of every document."""
    return quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_best_fit_packing")
def op4(spark, folder):
    """Bins of every piece of every document."""
    return best_fit_packing(table(spark, folder, "documents"))


@query("op6_source_mixing")
def op6(spark, folder):
    """Weight, passes and copies of every document in the mixture of sources."""
    return mixed_sources(table(spark, folder, "documents"))


@query("op11_sentencepiece")
def op11(spark, folder):
    """Ids of every document by the public merge model, and the text they give back."""
    model = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece_decode(sentencepiece_encode(table(spark, folder, "documents").select("doc_id", "text"), model), model)
    digest = lambda c: F.sha2(c, 256)
    ids = F.array_join("ids", ",")
    return both.select("doc_id", "n_tokens", digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
o AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM o, s GROUP BY term, nn),
b AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
    FROM b JOIN w USING (term) JOIN o USING (term), s GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""


@query("op12_ranked_search", _OP12_SQL)
def op12(spark, folder):
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query("op13_embedding_whitening")
def op13(spark, folder):
    """Whitened coordinates of every vector on the four leading components."""
    return embedding_whitening(table(spark, folder, "embeddings"))
