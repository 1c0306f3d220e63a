"""Imports every family so that its queries are registered."""

from tidemill.plans import anomaly_queries, block_queries, describe_queries, explain_queries, feature_queries, model_queries, prepare_queries, source_queries  # noqa: F401
from tidemill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
