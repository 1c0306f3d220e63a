"""Saved models: Spark ML folders with a registry row of name, features, parameters and bounds."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.sources.commits import claim_number

MODEL_ROW = (
    "model_name string, model_type string, version string, created_at timestamp, path string, train_start string, "
    "train_end string, parameters string, feature_names array<string>, metrics string, number bigint"
)


def save_model(
    model, root: str, name: str, created_at: datetime, features: list[str], bounds: tuple[str, str], metrics: dict[str, float]
) -> str:
    """Saves the model, then its registry row; of a name's rows that of the highest commit number is the active one.

    The number is in the folder's name, so two models of one name and second never share a folder.
    """
    spark = SparkSession.getActiveSession()
    number = claim_number(spark, root)
    version = f"{created_at:%Y%m%d_%H%M%S}"
    path = f"{root}/models/{name}/{version}_{number}"
    model.write().save(path)
    parameters = {p.name: v for p, v in model.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
    row = [(name, type(model).__name__, version, created_at, path, *bounds, json.dumps(parameters, sort_keys=True), features, json.dumps(metrics, sort_keys=True))]
    spark.createDataFrame(row, MODEL_ROW.removesuffix(", number bigint")).coalesce(1).write.parquet(f"{root}/registry/number={number}")
    return path


def model_registry(spark: SparkSession, root: str) -> DataFrame:
    """All saved models with a flag for the active version of each name."""
    rows = spark.read.schema(MODEL_ROW).parquet(f"{root}/registry")
    newest = Window.partitionBy("model_name").orderBy(F.desc("number"))
    return rows.withColumn("is_active", F.row_number().over(newest) == 1)


def load_model(spark: SparkSession, root: str, name: str):
    """The active model of a name."""
    row = model_registry(spark, root).where((F.col("model_name") == name) & F.col("is_active")).first()
    if row is None:
        raise LookupError(f"no model named {name!r} in {root}")
    return DefaultParamsReader.loadParamsInstance(row.path, spark)
