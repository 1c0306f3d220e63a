"""Feature-importance tables and the sentences read from them.

Input is long: optional keys, feature, importance. The number of features bounds
every group, so ranking windows partitioned by the keys stay small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, div, stable_round

# Category rules, tried in this order; (category, how, words).
RULES_AS_PUBLISHED = (
    ("lag", "prefix", ("lag_",)),
    ("rolling", "prefix", ("rolling_",)),
    ("growth", "part", ("growth", "momentum")),
    ("temporal", "part", ("temporal", "month", "quarter", "year", "sin", "cos")),
    ("decomposition", "part", ("decomp",)),
    ("fourier", "part", ("fourier",)),
    ("event", "part", ("is_", "festive", "lockdown")),
)
# The same rules with the narrow ones first, so that Fourier, momentum and
# year-based names reach their own category.
RULES_SPECIFIC_FIRST = (
    ("lag", "prefix", ("lag_",)),
    ("rolling", "prefix", ("rolling_",)),
    ("fourier", "part", ("fourier",)),
    ("momentum", "part", ("momentum",)),
    ("growth", "part", ("growth",)),
    ("decomposition", "part", ("decomp",)),
    ("event", "part", ("is_", "festive", "lockdown")),
    ("temporal", "part", ("temporal", "month", "quarter", "year", "sin", "cos")),
)


def _ordered(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(F.col("importance").desc(), "feature")


def importance_ranked(importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank from 1 and running total, highest importance first."""
    order = _ordered(by)
    running = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return importance.withColumn("rank", F.row_number().over(order)).withColumn("cumulative_importance", running)


def importance_top_n(importance: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """Top n with share and running share of the total over all features, in percent."""
    total = F.sum("importance").over(Window.partitionBy(*by))
    rows = importance_ranked(importance, by).withColumn("_total", total)

    def share(c: str) -> Column:
        return F.when(F.col("_total") > 0, F.col(c) / F.col("_total") * dbl(100.0)).otherwise(dbl(0.0))

    rows = rows.withColumn("importance_pct", share("importance")).withColumn("cumulative_pct", share("cumulative_importance"))
    return rows.where(F.col("rank") <= n).drop("_total", "cumulative_importance")


def category_of(feature: Column, rules=RULES_AS_PUBLISHED) -> Column:
    out = None
    for label, how, words in rules:
        cond = F.lit(False)
        for w in words:
            cond = cond | (feature.startswith(w) if how == "prefix" else feature.contains(w))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("other"))


def importance_by_category(importance: DataFrame, by: Sequence[str], rules=RULES_AS_PUBLISHED) -> DataFrame:
    rows = importance.withColumn("category", category_of(F.col("feature"), rules))
    return rows.groupBy(*by, "category").agg(
        stable_round(F.sum("importance"), 4).alias("importance"), F.count(F.lit(1)).alias("features")
    )


def importance_over_models(importance: DataFrame, n: int = 10) -> DataFrame:
    """Mean importance of each feature over the models that have it, top n."""
    mean = importance.groupBy("feature").agg(F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("models"))
    return mean.orderBy(F.col("importance").desc(), "feature").limit(n)


def _named(features: Column, words: Sequence[str], n: int) -> Column:
    """Comma list of the first n features containing any of the words; empty if none."""
    def match(f: Column) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | f.contains(w)
        return cond

    return F.array_join(F.slice(F.filter(features, match), 1, n), ", ")


# Sentences that explanations give as results.
SENTENCES = {
    "lag": "Past values significantly influence predictions. Key lags: ",
    "rolling": "Moving averages are important for predictions. Key windows: ",
    "growth": "Growth rates are predictive of future values. Features: ",
    "temporal": "Seasonality plays a role in predictions. Calendar features help capture periodic patterns.",
    "general": "Multiple features contribute to predictions. Top feature: ",
    "factors": "Key factors: ",
    "lead": "The most important feature is '%s' with %.1f%% relative importance.",
    "lag_sum": "Lag features contribute %.4f to the model.",
    "rolling_sum": "Rolling statistics contribute %.4f.",
    "temporal_sum": "Seasonal/temporal patterns contribute %.4f.",
}


def explain_text(importance: DataFrame, by: Sequence[str], top_n: int = 5) -> DataFrame:
    """Sentences on lags, rolling windows, growth and season among the top features."""
    top = importance_ranked(importance, by).where(F.col("rank") <= top_n)
    listed = top.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias("_f")
    )
    f = F.col("_f")

    def sentence(words, n, text):
        names = _named(f, words, n)
        return F.when(names != "", F.concat(F.lit(text), names))

    temporal = F.when(
        _named(f, ("month", "sin", "cos"), 1) != "",
        F.lit(SENTENCES["temporal"]),
    )
    parts = {
        "lag_importance": sentence(("lag",), 3, SENTENCES["lag"]),
        "rolling_importance": sentence(("rolling",), 2, SENTENCES["rolling"]),
        "growth_importance": sentence(("growth",), 2, SENTENCES["growth"]),
        "temporal_importance": temporal,
    }
    out = listed.select(*by, "_f", *[c.alias(name) for name, c in parts.items()])
    none = F.coalesce(*[F.col(c) for c in parts]).isNull()
    general = F.concat(F.lit(SENTENCES["general"]), F.get(F.col("_f"), F.lit(0)))
    return out.withColumn("general", F.when(none, general)).drop("_f")


def prediction_factors(values: DataFrame, importance: DataFrame, by: Sequence[str], ids: Sequence[str], top_n: int = 5) -> DataFrame:
    """"Key factors" text per row; ``values`` is long: ids, keys, feature, value."""
    top = importance_ranked(importance, by).where(F.col("rank") <= top_n).select(*by, "feature", "importance", "rank")
    rows = values.join(top, [*by, "feature"])
    text = F.format_string(
        "%s=%.2f (importance: %.4f)", F.col("feature"), stable_round(F.col("value"), 2), stable_round(F.col("importance"), 4)
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    joined = F.array_join(F.transform(parts, lambda s: s["text"]), "; ")
    return rows.groupBy(*ids).agg(F.concat(F.lit(SENTENCES["factors"]), joined).alias("explanation"))


def interpretability_report(importance: DataFrame, by: Sequence[str], top_n: int = 10) -> DataFrame:
    """Per key: top features, category totals, sentences and a summary, as one nested row."""
    by = list(by)
    top = importance_top_n(importance, by, top_n)
    tops = top.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "importance", "importance_pct", "cumulative_pct"))).alias("top_features")
    )
    totals = importance_by_category(importance, by)
    categories = totals.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "importance"))).alias("category_importance")
    )
    report = tops.join(categories, by).join(explain_text(importance, by, top_n), by)
    lead, cats = F.col("top_features")[0], F.col("category_importance")

    def line(category: str, text: str) -> Column:
        v = F.try_element_at(cats, F.lit(category))
        return F.when(v > 0, F.format_string(text, v))

    summary = F.concat_ws(
        " ",
        F.format_string(
            SENTENCES["lead"], lead["feature"], stable_round(lead["importance_pct"], 1)
        ),
        line("lag", SENTENCES["lag_sum"]),
        line("rolling", SENTENCES["rolling_sum"]),
        line("temporal", SENTENCES["temporal_sum"]),
    )
    return report.withColumn("summary", summary)
