"""The series the registered queries run on, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.prepare import calendar_fill, impute_linear
from tidemill.operators.rollup import monthly_rollup, rollup_by_dimension
from tidemill.sources.tables import read_table
from tidemill.spec import SeriesSpec

MILLION = 1e6

SEGMENT = SeriesSpec(keys=("segment",))
CUSTOMER = SeriesSpec(keys=("custkey",))
LINE = SeriesSpec(keys=("returnflag", "linestatus"))
EVENT_DAY = SeriesSpec(keys=("event_type",), freq="day", period=7)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders", "o_custkey", "o_orderdate", "o_totalprice")


def segment_series(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly order value (millions) and order count per market segment."""
    customers = read_table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return rollup_by_dimension(
        orders(spark, folder), customers, ("o_custkey", "c_custkey"), ["segment"], SEGMENT,
        ts="o_orderdate", measures={"y": "o_totalprice"}, unit=MILLION, scale=2,
    )


def segment_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Segment series on a complete calendar, gaps filled linearly."""
    return impute_linear(calendar_fill(segment_series(spark, folder), SEGMENT), SEGMENT).drop("is_gap", "imputed")


def customer_series(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse series: one per customer, months without orders have no row."""
    facts = orders(spark, folder).withColumnRenamed("o_custkey", "custkey")
    return monthly_rollup(facts, CUSTOMER, "o_orderdate", {"y": "o_totalprice"}, unit=MILLION, scale=2)


def line_series(spark: SparkSession, folder: str) -> DataFrame:
    """Two measures per return flag and line status: quantity and extended price (millions)."""
    facts = read_table(
        spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice"
    ).withColumnsRenamed({"l_returnflag": "returnflag", "l_linestatus": "linestatus"})
    return monthly_rollup(
        facts, LINE, "l_shipdate", {"y": "l_extendedprice", "quantity": "l_quantity"}, unit=MILLION, scale=2
    )


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    facts = read_table(spark, folder, "events", "event_type", "ts", "value")
    return monthly_rollup(facts, EVENT_DAY, "ts", {"y": "value"}, scale=6)


# -- SQL twins ---------------------------------------------------------------

SEGMENT_SQL = """
seg AS (
  SELECT c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y, COUNT(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""

# complete calendar with linear fill; leading gaps cannot occur (the grid starts at a real row)
SEGMENT_GRID_SQL = SEGMENT_SQL + """,
seg_span AS (SELECT segment, MIN(date) AS lo, MAX(date) AS hi FROM seg GROUP BY 1),
seg_cal AS (
  SELECT segment, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM seg_span),
seg_pos AS (
  SELECT c.segment, c.date, s.y, s.n, row_number() OVER (PARTITION BY c.segment ORDER BY c.date) AS i
  FROM seg_cal c LEFT JOIN seg s ON s.segment = c.segment AND s.date = c.date),
seg_near AS (
  SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
            last_value(y IGNORE NULLS) OVER b AS py,
            last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni,
            last_value(y IGNORE NULLS) OVER a AS ny
  FROM seg_pos
  WINDOW b AS (PARTITION BY segment ORDER BY date ROWS UNBOUNDED PRECEDING),
         a AS (PARTITION BY segment ORDER BY date DESC ROWS UNBOUNDED PRECEDING)),
grid AS (
  SELECT segment, date, i - 1 AS i,
         CASE WHEN y IS NOT NULL THEN y WHEN ny IS NULL THEN py
              ELSE py + (ny - py) / (ni - pi) * (i - pi) END AS y
  FROM seg_near),
gstat AS (SELECT segment, COUNT(*) AS len FROM grid GROUP BY 1),
g AS (SELECT grid.*, len FROM grid JOIN gstat USING (segment))
"""

CUSTOMER_SQL = """
cust AS (
  SELECT o_custkey AS custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y, COUNT(*) AS n
  FROM orders GROUP BY 1, 2)
"""

CUSTOMER_GRID_SQL = CUSTOMER_SQL + """,
cust_span AS (SELECT custkey, MIN(date) AS lo, MAX(date) AS hi FROM cust GROUP BY 1),
cust_cal AS (
  SELECT custkey, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM cust_span),
cgrid AS (
  SELECT c.custkey, c.date, s.y, s.n, s.date IS NULL AS is_gap,
         row_number() OVER (PARTITION BY c.custkey ORDER BY c.date) AS i
  FROM cust_cal c LEFT JOIN cust s ON s.custkey = c.custkey AND s.date = c.date)
"""

LINE_SQL = """
line AS (
  SELECT l_returnflag AS returnflag, l_linestatus AS linestatus,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS quantity, COUNT(*) AS n
  FROM lineitem GROUP BY 1, 2, 3)
"""
