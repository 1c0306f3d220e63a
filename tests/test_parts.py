import pytest
from series_rows import make_series

from tidemill import SeriesSpec
from tidemill.operators import describe, insights, stattests
from tidemill.operators.parts import alone, together

SERIES = {
    "trend": [10.0 + 2 * k + (5 if k % 12 in (9, 10) else 0) for k in range(48)],
    "flat": [3.0] * 30,
    "short": [4.0, 6.0],
    "one": [7.0],
}
PARTS = {
    "summary": describe.SUMMARY, "trend": describe.TREND, "distribution": describe.DISTRIBUTION, "shape": describe.SHAPE,
    "jarque_bera": describe.JARQUE_BERA, "adf": stattests.ADF, "kpss": stattests.KPSS,
    "autocorrelation": stattests.autocorrelation_part(),
}


def rows_by_key(df):
    return {r["key"]: r.asDict(True) for r in df.collect()}


def test_parts_together_equal_parts_alone(spark):
    spec = SeriesSpec(("key",))
    df = make_series(spark, SERIES).select("key", spec.time, spec.value)
    both = rows_by_key(together(df, spec, PARTS))
    assert set(both) == set(SERIES)
    for name, part in PARTS.items():
        for key, own in rows_by_key(alone(df, spec, part)).items():
            got = both[key][name]
            assert set(got) == set(own) - {"key"}
            for column, value in got.items():
                assert value == own[column] or value == pytest.approx(own[column], nan_ok=True), (name, key, column)


def test_reports_keep_every_series(spark):
    spec = SeriesSpec(("key",))
    df = make_series(spark, SERIES)
    report = rows_by_key(insights.eda_report(df, spec))
    assert set(report) == set(SERIES)
    assert [m["month"] for m in report["trend"]["monthly"]] == list(range(1, 13))
    found = insights.auto_insights(df, spec).collect()
    for key in SERIES:
        own = [(r["place"], r["rule"], r["text"]) for r in sorted(found, key=lambda r: r["place"]) if r["key"] == key]
        assert own == [(s["place"], s["rule"], s["text"]) for s in report[key]["auto_insights"]]
    empty = df.where("false")
    assert insights.eda_report(empty, spec).count() == 0 and insights.auto_insights(empty, spec).count() == 0
