"""Versioned datasets: one folder of rows per version, and a registry row written last,
so readers never see a version that is only partly there."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import require
from tidemill.sources.commits import claim_number
from tidemill.spec import SeriesSpec

REGISTRY = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("number", T.LongType()),
    ]
)


def content_hash(df: DataFrame, *extra: Column) -> DataFrame:
    """One row: eight hex digits that do not depend on row order, the row count, and extra aggregates."""
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    # xor alone would cancel equal rows out; the sum of half-width parts keeps them apart
    both = F.concat_ws("-", F.bit_xor(mixed), F.sum(F.shiftrightunsigned(mixed, 32)), F.count(F.lit(1)))
    return df.agg(F.substring(F.md5(both), 1, 8).alias("hash"), F.count(F.lit(1)).alias("record_count"), *extra)


def save_version(
    df: DataFrame, root: str, spec: SeriesSpec, source: str, created_at: datetime, csv_copy: bool = True
) -> str:
    """Writes the rows once, then the registry entry; returns the version name (time and content hash).

    Hash, span and CSV copy come from the rows as written, so whatever ``df`` is
    computed from is read a single time. A batch without registry entry (a failed
    save) is never read. The entry carries a commit number that no other save has: of interleaved
    saves all stay, and the one that committed last is the newest.
    """
    require(df, spec.time)
    spark = df.sparkSession
    batch = uuid.uuid4().hex
    df.write.parquet(f"{root}/rows/batch={batch}")
    kept = spark.read.parquet(f"{root}/rows/batch={batch}")
    facts = content_hash(
        kept,
        F.date_format(F.min(spec.time), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max(spec.time), "yyyy-MM-dd").alias("end_date"),
    ).first()
    version = f"{created_at:%Y%m%d_%H%M%S}_{facts.hash}"
    if csv_copy:
        kept.write.mode("overwrite").option("header", True).csv(f"{root}/csv/{version}")
    entry = [(version, facts.hash, created_at, facts.start_date, facts.end_date, facts.record_count, source, batch)]
    # a folder of its own for each commit: writers of one folder remove each other's temporary files
    folder = f"{root}/registry/number={claim_number(spark, root)}"
    spark.createDataFrame(entry, T.StructType(REGISTRY.fields[:-1])).coalesce(1).write.parquet(folder)
    return version


def version_info(spark: SparkSession, root: str) -> DataFrame:
    """Registry row of the highest commit number."""
    rows = spark.read.schema(REGISTRY).parquet(f"{root}/registry")
    return rows.orderBy(F.desc("number")).limit(1)


def load_latest_version(spark: SparkSession, root: str, spec: SeriesSpec) -> DataFrame:
    """Rows of the newest version in time order.

    The version is looked up first (one registry row), which turns the read into
    a single folder of the data.
    """
    newest = version_info(spark, root).first()
    if newest is None:
        raise LookupError(f"no version in {root}")
    return spark.read.parquet(f"{root}/rows/batch={newest.batch}").orderBy(*spec.ids)


def save_anomalies(anomalies: DataFrame, root: str, version: str) -> None:
    """Replaces the anomalies of one version, leaving other versions alone."""
    (
        anomalies.withColumn("dataset_version", F.lit(version))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_version").parquet(f"{root}/anomalies")
    )


def load_anomalies(spark: SparkSession, root: str, spec: SeriesSpec, version: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/anomalies")
    if version is not None:
        rows = rows.where(F.col("dataset_version") == version)
    return rows.orderBy(*spec.ids)


def cache_manifest(df: DataFrame, created_at: datetime) -> DataFrame:
    """Registry-style row for a derived table: time, content hash, row count, column list."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return content_hash(df).select(F.lit(created_at).alias("created_at"), "hash", "record_count", names.alias("columns"))
