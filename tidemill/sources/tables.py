"""Reading columnar tables and month files with explicit columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONTH_FILE = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("volume_millions", T.DoubleType()),
        T.StructField("value_crores", T.DoubleType()),
    ]
)
DATED_MONTH_FILE = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("volume_millions", T.DoubleType()),
        T.StructField("value_crores", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table; naming columns keeps the scan narrow."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType = MONTH_FILE) -> DataFrame:
    """Month table from CSV with a header; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)
