"""Hand-made series for tests, and their values as lists."""

import datetime as dt


def month(i, year=2020):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def make_series(spark, columns, start=2015):
    """{key: [values]} -> DataFrame(key, date, y) with consecutive months."""
    rows = [(k, month(i, start), None if v is None else float(v)) for k, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, date date, y double")


def values_of(df, column="y", key="key", time="date"):
    """{key: [values in time order]}"""
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r[key], r[time])):
        out.setdefault(row[key], []).append(row[column])
    return out
