import datetime as dt

import numpy as np
import pytest
from series_rows import make_series, month, values_of
from pyspark.sql import functions as F

from tidemill.functions.text import coerce_numeric, parse_month, parse_number
from tidemill.operators import prepare
from tidemill.operators.rollup import monthly_rollup, rollup_by_dimension
from tidemill.sources.html import first_table_rows, matching_table_rows
from tidemill.spec import SeriesSpec


def dirty(spark):
    rows = [
        ("a", 1, month(0), 10.0), ("a", 2, month(0), 11.0), ("a", 5, month(4), 15.0), ("a", 4, month(3), -1.0),
        ("a", 3, month(1), 12.0), ("b", 1, month(0), None), ("b", 2, month(1), 2.0), ("b", 3, month(2), None),
        ("b", 4, month(3), 4.0), ("b", 5, month(4), None),
    ]
    return spark.createDataFrame(rows, "key string, seq long, date date, y double")


def test_dedupe_keeps_highest_sequence(spark, spec):
    out = prepare.dedupe_keep_last(dirty(spark), spec, "seq")
    assert values_of(out)["a"] == [11.0, 12.0, -1.0, 15.0]


def test_dedupe_with_one_hot_period(spark, spec):
    rows = spark.range(30_000).select(
        F.lit("hot").alias("key"), F.col("id").alias("seq"), F.lit(month(0)).alias("date"), F.col("id").cast("double").alias("y")
    )
    assert values_of(prepare.dedupe_keep_last(rows, spec, "seq")) == {"hot": [29_999.0]}


def test_clean_fills_gap_bad_and_edge_values(spark, spec):
    out = values_of(prepare.clean(dirty(spark), spec, "seq"))
    # month 2 is missing, month 3 was negative: both on the line from 12 to 15
    assert out["a"] == [11.0, 12.0, 13.0, 14.0, 15.0]
    # leading null stays, trailing null takes the last value
    assert out["b"] == [None, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize(
    "method, want",
    [
        ("forward", [None, 2.0, 2.0, 4.0, 4.0]), ("backward", [2.0, 2.0, 4.0, 4.0, None]),
        ("mean", [3.0, 2.0, 3.0, 4.0, 3.0]), ("median", [3.0, 2.0, 3.0, 4.0, 3.0]),
    ],
)
def test_imputation_methods(spark, spec, method, want):
    rows = dirty(spark).where("key = 'b'").drop("seq")
    out = prepare.impute(rows, spec, method)
    assert values_of(out)["b"] == want
    report = prepare.impute_report(out, spec, method).first()
    assert report.missing_before == 3 and report.values_imputed == 3 - want.count(None)


def test_unknown_imputation_is_refused(spark, spec):
    with pytest.raises(ValueError, match="unknown imputation"):
        prepare.impute(dirty(spark), spec, "guess")


def test_spline_reproduces_a_straight_line_and_passes_known_points(spark, spec):
    line = [2.0 * i + 1 for i in range(12)]
    holes = [v if i not in (3, 4, 8) else None for i, v in enumerate(line)]
    curve = [np.sin(i / 3) for i in range(24)]
    curved = [v if i % 7 != 3 else None for i, v in enumerate(curve)]
    out = values_of(prepare.impute_spline(make_series(spark, {"line": holes, "curve": curved}), spec))
    assert np.allclose(out["line"], line)
    assert np.allclose(out["curve"], curve, atol=0.02)


def test_calendar_fill_and_missing_periods_agree(spark, spec):
    rows = spark.createDataFrame([("a", month(i), 1.0) for i in (0, 1, 5, 9)], "key string, date date, y double")
    grid = prepare.calendar_fill(rows, spec)
    assert grid.count() == 10
    gaps = {r.date for r in grid.where("is_gap").collect()}
    assert gaps == {r.date for r in prepare.missing_periods(rows, spec).collect()}
    assert prepare.calendar_fill(rows, spec, "zero").where("y = 0").count() == 6


def test_absurd_gap_fails_loudly(spark, spec):
    rows = spark.createDataFrame([("a", month(0), 1.0), ("a", month(400), 1.0)], "key string, date date, y double")
    assert prepare.calendar_fill(rows, spec).count() == 401
    with pytest.raises(Exception, match="calendar gap of more than 100 steps after a 2020-01-01"):
        prepare.calendar_fill(rows, spec, max_gap=100).collect()


def test_hourly_and_daily_calendars(spark):
    hour = SeriesSpec(keys=("key",), freq="hour", period=24)
    rows = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 0), 1.0), ("a", dt.datetime(2024, 1, 1, 5), 2.0)], "key string, date timestamp, y double"
    )
    assert prepare.calendar_fill(rows, hour).count() == 6
    day = SeriesSpec(keys=("key",), freq="day", period=7)
    rows = spark.createDataFrame([("a", dt.date(2024, 2, 27), 1.0), ("a", dt.date(2024, 3, 1), 2.0)], "key string, date date, y double")
    assert prepare.calendar_fill(rows, day).count() == 4
    assert prepare.future_calendar(rows, day, 3).agg(F.max("date")).first()[0] == dt.date(2024, 3, 4)


def test_order_violations_are_found_across_blocks(spark, spec):
    rows = [("a", s, month(i), 1.0) for s, i in enumerate([0, 1, 2, 1, 3, 4, 3, 5])]
    rows += [("b", s, month(s), 1.0) for s in range(8)]
    df = spark.createDataFrame(rows, "key string, seq long, date date, y double")
    for block in (2, 3, 100):
        out = {r.key: r.order_violations for r in prepare.order_violations(df, spec, "seq", block).collect()}
        assert out == {"a": 2, "b": 0}, block


def test_rollup_by_dimension_equals_joining_first(spark):
    facts = spark.range(5000).select(
        # one join key holds a third of the rows
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"),
        F.expr("timestamp'2020-01-15' + make_interval(0, cast(id % 14 as int))").alias("ts"),
        (F.col("id") / 100).alias("v"),
    )
    dim = spark.createDataFrame([(i, f"g{i % 4}") for i in range(50)], "k2 int, grp string")
    s = SeriesSpec(keys=("grp",))
    got = rollup_by_dimension(facts, dim, ("k", "k2"), ["grp"], s, "ts", {"y": "v"}, scale=2)  # sums of whole hundredths
    want = monthly_rollup(facts.join(dim, facts.k == dim.k2), s, "ts", {"y": "v"}, scale=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_series_without_keys_get_one(spark):
    facts = spark.createDataFrame([(dt.datetime(2020, 1, 5), 1.0), (dt.datetime(2020, 1, 9), 2.0)], "ts timestamp, v double")
    row = monthly_rollup(facts, SeriesSpec(), "ts", {"y": "v"}).first()
    assert (row.series, row.y, row.n) == ("ALL", 3.0, 2)


def test_unrelated_key_changes_nothing(spark, spec):
    one = {"a": [1, None, 3, 9, 2, 8, None, 4, 4, 5, 7, 1, 2, 3]}
    alone = values_of(prepare.impute_linear(make_series(spark, one), spec))["a"]
    both = values_of(prepare.impute_linear(make_series(spark, {**one, "z": [5.0] * 3}), spec))["a"]
    assert alone == both


def test_months_and_numbers(spark):
    texts = ["Apr-16", "Jan 2016", "feb/99", "???", None, "zzz-07", "March 49"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_month(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [
        dt.date(2016, 4, 1), dt.date(2016, 1, 1), dt.date(1999, 2, 1), None, None, dt.date(2007, 1, 1), dt.date(2049, 3, 1)
    ]
    numbers = ["1,234.56", "12.5M", "1.2B", "500K", "3Cr", "n/a", "", "1 000"]
    df = spark.createDataFrame([(t,) for t in numbers], "t string").select(
        parse_number(F.col("t")).alias("n"), coerce_numeric(F.col("t")).alias("c")
    )
    assert [r.n for r in df.collect()] == [1234.56, 12.5, 1200.0, 0.5, 30.0, None, None, 1000.0]
    assert [r.c for r in df.collect()] == [1234.56, None, None, None, None, None, None, 1000.0]


def test_html_tables(spark):
    pages = [
        (1, "<p>no table</p>"),
        (2, "<table><tr><th>Month<th>Volume<th>Value<tr><td>Apr-16<td>1,5<td>2 Cr<tr><td>May-16<td>n/a<td>1</table>"),
        (3, "<TABLE><tr><td>x</td></tr></TABLE><table><thead><tr><th>Transactions</th></tr></thead>"
            "<tr><td><b>a &amp; b</b></td><td>2</td></tr><tr><td>lone</td></tr></table>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    rows = [tuple(r) for r in first_table_rows(df).collect()]
    assert rows == [(2, 1, "Apr-16", 15.0, 20.0)]
    found = sorted((r.page_id, r.cells) for r in matching_table_rows(df).collect())
    assert found == [(2, ["Apr-16", "1,5", "2 Cr"]), (2, ["May-16", "n/a", "1"]), (3, ["a & b", "2"])]
