import ast
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemill.operators import anomaly, features
from tidemill.plans import tables as tb

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parents[1] / "tidemill"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_table_needs_one_exchange_after_the_rollup(spark):
    grid = tb.segment_series(spark, FOLDER)
    before = plan_of(grid).count("Exchange hashpartitioning")
    after = plan_of(features.create_features(grid.drop("n"), tb.SEGMENT)).count("Exchange hashpartitioning")
    assert after == before + 1
    scored = plan_of(anomaly.anomaly_combined(grid.drop("n"), tb.SEGMENT)).count("Exchange hashpartitioning")
    assert scored == before + 1


def test_facts_are_combined_before_any_shuffle(spark):
    lines = plan_of(tb.segment_series(spark, FOLDER)).splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line and "o_totalprice" in line)
    first_shuffle = max(k for k in range(scan) if "Exchange" in lines[k])
    assert any("partial_sum" in line for line in lines[first_shuffle:scan])


@pytest.mark.parametrize("name", ["ensemble_inverse_rmse", "forecast_explanation", "forecast_arima", "stationarity_verdict"])
def test_facts_are_scanned_once_however_often_the_series_is_used(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[o_custkey", final)) == 1


def test_comparisons_of_models_read_a_written_series(spark):
    df = entry.queries()["walk_forward_cv_average"](spark, FOLDER)
    df.collect()
    assert "FileScan" not in plan_of(df)


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(tb.segment_series(spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("o_totalprice" in s and "o_orderpriority" not in s for s in schemas)
    assert any("c_mktsegment" in s and "c_acctbal" not in s for s in schemas)


@pytest.mark.parametrize("name", ["eda_report", "auto_insights", "executive_findings", "residual_report", "dashboard_kpis"])
def test_reports_are_made_in_few_passes(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert len(re.findall(r"\bExchange\b", plan)) <= 12 and len(re.findall(r"\bSort\b", plan)) <= 20
    assert "FileScan" not in plan  # the series is written once


QUICK = ("segment_overview", "calendar_fill", "union_anomalies", "acf", "walk_forward_folds", "ensemble_inverse_rmse", "scenario_projection")


@pytest.mark.parametrize("name", QUICK)
def test_no_cross_joins_and_no_global_windows(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan


def test_library_pulls_no_rows_to_the_driver():
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "crossJoin", "take"}
    for path in (p for p in PACKAGE.rglob("*.py") if p.parent.name != "llm"):  # its tests list the bounded ones
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in banned, f"{path}: {node.func.attr}"


def test_every_query_is_registered_with_matching_twins():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
