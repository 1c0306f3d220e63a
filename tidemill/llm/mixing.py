"""Mixing of sources by temperature, in DataFrame operations only.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is the smallest in [0, 1]
at which the entropy of the weights is at most the target and no source is repeated more often than allowed.
Weights become passes: whole passes over a source, and one pass over a part of it, taken in the order of a
permutation of blocks of documents up to the token budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.packing import word_count
from tidemill.session import cut_lineage

GRID, ROUNDS, DIGITS = 16, 7, 6
SALTS = 64


@dataclass(frozen=True)
class Mix:
    """``entropy``: target in nats; None: halfway between that of the shares and that of equal shares.

    ``max_repeats``: most passes over any source. ``budget``: tokens in all; None: as many as give the least
    repeated source one whole pass, so that no document is lost.
    """

    entropy: float | None = None
    max_repeats: float = 4.0
    budget: int | None = None
    block_docs: int = 1024
    seed: int = 7


def draw(*parts: Column) -> Column:
    """Permutation key: md5 of the parts."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("bigint")


def exponent(sources: DataFrame, mix: Mix) -> tuple[float, float]:
    """The exponent to DIGITS digits and the tokens of the mixture; a few numbers a round reach the driver."""
    n, total, least, most = sources.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n or not total:
        return 1.0, 0.0
    share = F.col("tokens") / F.lit(float(total))

    def measured(alphas: list[float]) -> list[tuple[float, float, float]]:
        rows = sources.withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in alphas))))
        power = F.pow(share, F.col("alpha"))
        rows = rows.groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("a"))
        return sorted((r["alpha"], r["z"], math.log(r["z"]) - r["alpha"] * r["a"] / r["z"]) for r in rows.collect())

    def tokens(alpha: float, z: float) -> float:
        """Of the mixture; for exponents up to 1 the largest source is the least repeated."""
        return float(mix.budget) if mix.budget is not None else most * z / (most / total) ** alpha

    def repeats(alpha: float, z: float) -> float:
        return tokens(alpha, z) * (least / total) ** alpha / z / least

    natural = measured([1.0])[0]
    target = mix.entropy if mix.entropy is not None else (natural[2] + math.log(n)) / 2
    low, high = -1.0 / GRID, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / GRID
        fits = [
            a for a, z, h in measured([max(0.0, low + step * k) for k in range(1, GRID + 1)])
            if h <= target + 1e-12 and repeats(a, z) <= mix.max_repeats + 1e-12
        ]
        high = min(fits, default=1.0)
        low = high - step
        if high <= 0:
            break
    alpha = min(1.0, math.ceil(max(0.0, high) * 10**DIGITS) / 10**DIGITS)
    return alpha, tokens(alpha, measured([alpha])[0][1])


def mixed_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, repeats, copies) for every row of ``docs``.

    ``tokens``: tokens of a document; default its words and one end. weight: of the row's source; repeats: its
    passes; copies: how often the document is in the mixture, the whole passes plus one if the permutation of
    the last pass reaches it within the budget (a part pass takes documents while their
    tokens fit, so a source stays at most one document under its budget).

    A null source is a source of its own. A null text has only its end token. Null ids are permuted as one id;
    rows equal in id and tokens may be exchanged for each other. Empty input gives no rows; other columns
    are ignored. A hot source is dealt into blocks; windows run over the blocks of a source and
    the documents of a block.
    """
    n = word_count(F.col(f"`{text}`")) + F.lit(1) if tokens is None else F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1))
    rows = cut_lineage(
        docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n.cast("bigint").alias("n_tokens"))
    )
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = rows.withColumn("key", key)
    sources = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    alpha, size = exponent(sources, mix)
    z_sum = sources.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    power = F.pow(F.col("tokens") / F.lit(z_sum), F.lit(alpha))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = sources.withColumn("weight", power / F.lit(z)).withColumn("repeats", F.lit(size) * F.col("weight") / F.col("tokens"))
    # an exact number of passes stays one in spite of the last digit
    plan = plan.withColumn("whole", F.floor(F.col("repeats") + F.lit(1e-9)))
    plan = plan.withColumn("rest", F.floor(F.greatest(F.col("repeats") - F.col("whole"), F.lit(0.0)) * F.col("tokens") + F.lit(1e-6)))
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / F.lit(mix.block_docs)))
    seed = F.lit(mix.seed)
    # the plan of a source is met under several salts, so that a hot source's rows do not meet it in one task
    drawn = number(draw(seed, F.coalesce("doc_id", F.lit(-1)), F.col("n_tokens")))
    rows = rows.withColumn("drawn", drawn).withColumn("salt", F.col("drawn") % F.lit(SALTS))
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    rows = rows.join(plan, ["key", "salt"]).withColumn("block", F.col("drawn") % F.col("blocks"))

    blocks = rows.groupBy("key", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("whole").alias("pass"))
    permuted = Window.partitionBy("key").orderBy(draw(seed, F.col("pass"), F.col("key"), F.col("block"))).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("block_tokens").over(permuted), F.lit(0)).alias("before"))
    order = (draw(seed, F.col("whole"), F.coalesce("doc_id", F.lit(-1)), F.col("n_tokens")), F.col("doc_id"), F.col("n_tokens"))
    inside = Window.partitionBy("key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["key", "block"]).withColumn("until", F.col("before") + F.sum("n_tokens").over(inside))
    copies = F.col("whole") + (F.col("until") <= F.col("rest")).cast("bigint")
    return rows.select("doc_id", "source", "n_tokens", "weight", "repeats", copies.alias("copies"))


def mixture(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture holds it, with all their columns.

    Rows that share a doc_id are repeated as often as the most repeated of them.
    """
    times = mixed_sources(docs, mix, doc_id, text, source).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("mixed_copies"))
    out = docs.join(times, F.col(f"`{doc_id}`").eqNullSafe(F.col("mixed_id")))
    out = out.where("mixed_copies > 0").withColumn("mixed_pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mixed_copies"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
