"""Documents to packed training sequences: the stages, and one call that runs them all.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the
columns of documents; other columns are left out at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.mixing import mixture
from tidemill.llm.packing import best_fit_packing
from tidemill.llm.quality_classifier import quality_filter
from tidemill.llm.substring_dedup import substring_dedup
from tidemill.session import scratch_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier keeps."""
    return quality_filter(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at Jaccard 0.8 or more: of the least id, ids before nulls.

    Rows are told apart by a hash of all columns, equal rows count as one. Texts without words link with nothing: all of them stay.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = rows.where(has_words)
    kept = jaccard_components(worded, n=5, percent=80, row="row").where("kept").select("row").distinct()
    equal = Window.partitionBy("row").orderBy("row")
    stay = worded.join(kept, "row", "left_semi").withColumn("copy", F.row_number().over(equal)).where("copy = 1")
    return stay.select(*COLUMNS).unionByName(rows.where(~has_words).select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that occur earlier; a text left untouched keeps its layout."""
    cut = substring_dedup(docs.select(*COLUMNS), window=20, carry=("lang", "source", "n_chars"), keep_layout=True)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture holds them; every document at least once."""
    return mixture(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 512 to 4096 tokens."""
    return best_fit_packing(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Hash models, prefix trees and packing heuristics have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
