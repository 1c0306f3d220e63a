"""Quality rules: a table of thresholds compiled into one Spark projection, no user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "was", "for", "with", "it", "be", "or", "by",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "est", "ou", "pour", "que",
    "der", "die", "das", "und", "ist", "ein", "eine", "zu", "mit", "von", "den",
    "el", "los", "las", "y", "del", "por", "con", "para", "se", "su",
)


@dataclass(frozen=True)
class Limit:
    """A row passes where low <= metric <= high; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are ratios of the counts below, each 0 where its denominator is 0.
LIMITS = (
    Limit("word_length", "mean_word_chars", 2.0, 14.0),
    Limit("symbols", "symbols_per_word", None, 0.1),
    Limit("stop_words", "stop_word_share", 0.01, None),
    Limit("repeated_lines", "dup_line_share", None, 0.3),
)
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}


def ratio(metric: str) -> Column:
    a, b = RATIOS[metric]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def failed(limit: Limit) -> Column:
    tests = [F.col(limit.metric) < F.lit(float(limit.low))] if limit.low is not None else []
    tests += [F.col(limit.metric) > F.lit(float(limit.high))] if limit.high is not None else []
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of every text, one projection after the other: no shuffle, no Python."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), raw.alias("text"))
    df = df.select(
        "doc_id",
        F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(F.translate("text", SPACES + " ", "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
    )
    following = lambda i, k: F.get("words", i + F.lit(k))
    # 3-word windows by hash, then by place: equal neighbours are the repeated ones
    windows = F.sort_array(
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - F.lit(2), F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, following(i, 1), following(i, 2)).alias("h"), i.alias("i")),
        )
    )
    df = df.select(
        "doc_id", F.size("words").alias("n_words"), "word_chars", "n_symbols", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        windows.alias("windows"),
    )
    near = lambda j, k: F.get("windows", j + F.lit(k))["h"]
    again = F.filter("windows", lambda x, j: (x["h"] == near(j, -1)) | (x["h"] == near(j, 1)))
    df = df.withColumn("windows", F.sort_array(F.transform(again, lambda x: x["i"])))
    new = F.transform("windows", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("windows", j + F.lit(1)) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(new, F.lit(0), lambda a, b: a + b)).drop("windows")
    return df.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in df.columns if c != "doc_id"))


def quality_rules(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, one flag per limit, and kept.

    Base: at least 50 words, at most half of them in repeated 3-word windows. A null text counts as
    empty, which fails the base; null or repeated ids and repeated rows give one row each; other columns are
    ignored. Window equality is that of 64-bit hashes inside one text.
    """
    df = measured(docs, doc_id, text)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    df = df.withColumns({m: ratio(m) for m in RATIOS})
    df = df.withColumns({f"fails_{x.name}": failed(x) for x in limits})
    any_failed = reduce(lambda a, b: a | b, (F.col(f"fails_{x.name}") for x in limits), F.col("base_failed"))
    return df.withColumn("kept", ~any_failed)
