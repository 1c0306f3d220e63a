"""Sources, sinks, versions and text parsing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import month_label
from tidemill.functions.text import coerce_numeric, parse_month, parse_number
from tidemill.operators import anomaly, ensemble
from tidemill.plans import model_queries as mq
from tidemill.plans import tables as tb
from tidemill.plans.anomaly_queries import SCORED_SQL
from tidemill.plans.registry import query, r, rs
from tidemill.session import scratch_folder
from tidemill.sources import export, html, tables, versions
from tidemill.spec import SeriesSpec

SEG = tb.SEGMENT


def order_texts(spark, folder) -> DataFrame:
    """Month and figure texts in the spellings found in published tables, from every order."""
    rows = tables.read_table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    style = F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    month = (
        F.when(style == 0, F.date_format(d, "MMM-yy")).when(style == 1, F.date_format(d, "MMMM yyyy"))
        .when(style == 2, F.lower(F.date_format(d, "MMM/yy"))).when(style == 3, F.concat(F.lit(" Xyz "), F.date_format(d, "yyyy")))
        .otherwise(F.lit("???"))
    )
    figure = F.format_number("o_totalprice", 2)
    number = (
        F.when(style == 0, F.concat(figure, F.lit("M"))).when(style == 1, F.concat(figure, F.lit(" B")))
        .when(style == 2, F.concat(figure, F.lit("K"))).when(style == 3, F.concat(figure, F.lit("Cr"))).otherwise(figure)
    )
    return rows.select("o_orderkey", "o_totalprice", style.alias("style"), month.alias("month"), number.alias("number"))


@query(
    "parse_month",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 3 THEN date_trunc('year', o_orderdate) WHEN 4 THEN NULL
              ELSE date_trunc('month', o_orderdate) END AS DATE) AS date FROM orders""",
)
def parse_month_query(spark, folder):
    return order_texts(spark, folder).select("o_orderkey", parse_month(F.col("month")).alias("date"))


FACTOR = "CASE o_orderkey % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 1000e0 WHEN 2 THEN 0.001e0 WHEN 3 THEN 10e0 ELSE 1e0 END"


@query("parse_number", f"SELECT o_orderkey, {r(f'o_totalprice * {FACTOR}', 'millions')} FROM orders")
def parse_number_query(spark, folder):
    return order_texts(spark, folder).select("o_orderkey", parse_number(F.col("number")).alias("millions"))


@query("coerce_numeric", f"SELECT o_orderkey, {r('CASE WHEN o_orderkey % 5 = 4 THEN o_totalprice END', 'number')} FROM orders")
def coerce_numeric_query(spark, folder):
    return order_texts(spark, folder).select("o_orderkey", coerce_numeric(F.col("number")).alias("number"))


def statistics_pages(spark, folder) -> DataFrame:
    """One statistics page per order, next to all crawled pages (which hold no tables)."""
    t = order_texts(spark, folder)
    head = "<html><body><h1>Product &amp; statistics</h1><table class='x'><tr><th>Month</th><th>Volume</th><th>Value</th></tr>"
    body = F.concat(
        F.lit(head), F.lit("<TR><td> <b>"), F.col("month"), F.lit("</b>&nbsp;</td><td>"), F.col("number"),
        F.lit("</td><td><i>1,5</i>00</td></TR><tr><td colspan='2'>Total</td><td>"), F.col("number"), F.lit("</td></tr></table></body></html>"),
    )
    made = t.select(F.col("o_orderkey").alias("page_id"), body.alias("html"))
    crawled = tables.read_table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("page_id"), "html")
    return made.unionByName(crawled)


MONTH_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%b-%y') WHEN 1 THEN strftime(o_orderdate, '%B %Y')
  WHEN 2 THEN lower(strftime(o_orderdate, '%b/%y')) WHEN 3 THEN 'Xyz ' || strftime(o_orderdate, '%Y') ELSE '???' END"""


@query(
    "html_table_rows",
    f"""SELECT o_orderkey AS page_id, CAST(1 AS BIGINT) AS row_no, {MONTH_TEXT} AS month,
        {r(f'o_totalprice * {FACTOR}', 'volume')}, {r('1500e0', 'value')} FROM orders""",
)
def html_table_rows(spark, folder):
    return html.first_table_rows(statistics_pages(spark, folder))


@query(
    "html_table_rows_by_header",
    f"""SELECT o_orderkey AS page_id, CAST(k AS BIGINT) AS row_no, CASE k WHEN 0 THEN {MONTH_TEXT} ELSE 'Total' END AS first_cell,
        CAST(3 - k AS BIGINT) AS cells, 'month,volume,value' AS headers FROM orders, range(2) t(k)""",
)
def html_table_rows_by_header(spark, folder):
    rows = html.matching_table_rows(statistics_pages(spark, folder))
    return rows.select(
        "page_id", "row_no", F.col("cells")[0].alias("first_cell"), F.size("cells").alias("cells"),
        F.array_join("headers", ",").alias("headers"),
    )


# -- files and versions ------------------------------------------------------


@query(
    "read_series_csv",
    f"""WITH {tb.LINE_SQL} SELECT returnflag || linestatus || ' ' || strftime(date, '%b %Y') AS month,
        {rs('volume_millions=quantity', 'value_crores=y')} FROM line""",
)
def read_series_csv(spark, folder):
    path = scratch_folder(spark, "months")
    rows = tb.line_series(spark, folder).select(
        F.concat("returnflag", "linestatus", F.lit(" "), F.date_format("date", "MMM yyyy")).alias("month"),
        F.col("quantity").alias("volume_millions"), F.col("y").alias("value_crores"),
    )
    export.write_text(rows, path)
    return tables.read_series_csv(spark, path)


def stored(spark, folder) -> str:
    """Two versions of the segment series: one without its newest year, then the whole."""
    root = scratch_folder(spark, "versions")
    whole = tb.segment_series(spark, folder)
    early = whole.where(F.col("date") < F.lit("2000-01-01").cast("date"))
    versions.save_version(early, root, SEG, "orders", datetime(2026, 1, 1, 8))
    versions.save_version(whole, root, SEG, "orders", datetime(2026, 2, 1, 8))
    return root


INFO_SQL = f"""WITH {tb.SEGMENT_SQL}
SELECT '20260201_080000' AS saved, strftime(MIN(date), '%Y-%m-%d') AS start_date, strftime(MAX(date), '%Y-%m-%d') AS end_date,
       COUNT(*) AS record_count, 'orders' AS source FROM seg"""


@query(
    "save_version",
    f"""WITH {tb.SEGMENT_SQL}, v AS (SELECT '20260101_080000' AS saved, * FROM seg WHERE date < DATE '2000-01-01'
          UNION ALL SELECT '20260201_080000', * FROM seg)
        SELECT saved, strftime(MIN(date), '%Y-%m-%d') AS start_date, strftime(MAX(date), '%Y-%m-%d') AS end_date,
               COUNT(*) AS record_count, 'orders' AS source FROM v GROUP BY 1""",
)
def save_version(spark, folder):
    rows = spark.read.parquet(f"{stored(spark, folder)}/registry")
    return rows.select(F.substring("version", 1, 15).alias("saved"), "start_date", "end_date", "record_count", "source")


@query("version_info", INFO_SQL)
def version_info(spark, folder):
    row = versions.version_info(spark, stored(spark, folder))
    return row.select(F.substring("version", 1, 15).alias("saved"), "start_date", "end_date", "record_count", "source")


@query("load_latest_version", f"WITH {tb.SEGMENT_SQL} SELECT segment, date, {rs('y')}, n FROM seg")
def load_latest_version(spark, folder):
    return versions.load_latest_version(spark, stored(spark, folder), SEG)


@query(
    "save_load_anomalies",
    f"{SCORED_SQL} SELECT segment, date, {rs('y', 'z_score')}, severity, 'v2' AS dataset_version FROM sc WHERE is_anomaly",
)
def save_load_anomalies(spark, folder):
    root = scratch_folder(spark, "anomalies")
    scored = anomaly.anomaly_combined(tb.segment_series(spark, folder).drop("n"), SEG)
    found = scored.where("is_anomaly").select("segment", "date", "y", "z_score", "severity")
    versions.save_anomalies(found, root, "v1")
    versions.save_anomalies(found, root, "v2")
    return versions.load_anomalies(spark, root, SEG, "v2")


@query(
    "cache_manifest",
    f"WITH {tb.SEGMENT_SQL} SELECT COUNT(*) AS record_count, 'segment,date,y,n' AS columns, CAST(8 AS BIGINT) AS hash_length FROM seg",
)
def cache_manifest(spark, folder):
    row = versions.cache_manifest(tb.segment_series(spark, folder), datetime(2026, 1, 1))
    return row.select("record_count", F.array_join("columns", ",").alias("columns"), F.length("hash").alias("hash_length"))


@query(
    "export_forecast_long",
    f"""{mq.GREC}{mq.FC}{mq.BM} SELECT segment, strftime(date, '%Y-%m') AS date, model, {r(r('yhat', digits=2), 'prediction')},
        {rs('rmse', 'mae', 'mape')} FROM fc JOIN bm USING (segment, model)""",
)
def export_forecast_long(spark, folder):
    path = scratch_folder(spark, "forecast")
    rows = export.export_forecast_long(mq.averages(mq.series(spark, folder)), SEG, mq.backtest_metrics(spark, folder))
    export.write_text(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "export_forecast_bounds",
    f"""{mq.GREC}{mq.FC} SELECT segment, strftime(date, '%Y-%m') AS date, model, {r(r('yhat', digits=2), 'prediction')},
        {r(r('yhat - yhat * 0.1', digits=2), 'confidence_lower')}, {r(r('yhat + yhat * 0.1', digits=2), 'confidence_upper')} FROM fc""",
)
def export_forecast_bounds(spark, folder):
    path = scratch_folder(spark, "forecast")
    rows = export.export_forecast_long(ensemble.interval_fixed_pct(mq.averages(mq.series(spark, folder))), SEG)
    export.write_text(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("export_series", f"WITH {tb.SEGMENT_SQL} SELECT segment, strftime(date, '%Y-%m') AS date, {rs('y')}, n FROM seg")
def export_series(spark, folder):
    path = scratch_folder(spark, "series")
    rows = tb.segment_series(spark, folder)
    export.export_series(rows, SEG, path, "json")
    fields = [T.StructField(f.name, T.StringType() if f.name == "date" else f.dataType) for f in rows.schema.fields]
    return spark.read.schema(T.StructType(fields)).json(path)
