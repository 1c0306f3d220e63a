"""Roll-up, filters, calendar, joins, dedup and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import anomaly, features, prepare, rollup
from tidemill.operators.rollup import drop_partial_last
from tidemill.plans import tables as tb
from tidemill.plans.registry import query, r, rs
from tidemill.sources.tables import read_table
from tidemill.spec import SeriesSpec

SEG, CUST = tb.SEGMENT, tb.CUSTOMER


@query("monthly_rollup", f"WITH {tb.LINE_SQL} SELECT returnflag, linestatus, date, {rs('y', 'quantity')}, n FROM line")
def monthly_rollup(spark, folder):
    return tb.line_series(spark, folder)


@query("rollup_by_dimension", f"WITH {tb.SEGMENT_SQL} SELECT segment, date, {rs('y')}, n FROM seg")
def rollup_by_dimension(spark, folder):
    return tb.segment_series(spark, folder).withColumn("n", F.col("n").cast("bigint"))


@query(
    "daily_rollup",
    f"""SELECT event_type, CAST(ts AS DATE) AS date,
       {r("CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE)", "y")}, COUNT(*) AS n
       FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
)
def daily_rollup(spark, folder):
    return tb.event_series(spark, folder)


@query(
    "drop_partial_last",
    f"""WITH {tb.SEGMENT_SQL} SELECT segment, date, {rs('y')}, n FROM seg
        WHERE date < (SELECT MAX(date) FROM seg s WHERE s.segment = seg.segment)""",
)
def drop_partial(spark, folder):
    return drop_partial_last(tb.segment_series(spark, folder), SEG)


@query(
    "date_range_filter",
    f"WITH {tb.SEGMENT_SQL} SELECT segment, date, {rs('y')} FROM seg "
    "WHERE date BETWEEN DATE '1996-04-01' AND DATE '1999-03-01'",
)
def date_range_filter(spark, folder):
    rows = prepare.date_range_filter(tb.segment_series(spark, folder), SEG, "1996-04-01", "1999-03-01")
    return rows.drop("n")


@query(
    "last_n_periods",
    f"""WITH {tb.CUSTOMER_SQL} SELECT custkey, date, {rs('y')} FROM (
        SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY date DESC) AS age FROM cust) WHERE age <= 12""",
)
def last_n_periods(spark, folder):
    return prepare.last_n_periods(tb.customer_series(spark, folder), CUST, 12).drop("n")


@query(
    "split_last_n",
    f"""WITH {tb.SEGMENT_SQL} SELECT segment, date, {rs('y')},
        CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY date DESC) <= 12 THEN 'test' ELSE 'train' END AS split
        FROM seg""",
)
def split_last_n(spark, folder):
    return prepare.split_last_n(tb.segment_series(spark, folder), SEG, 12).drop("n")


@query(
    "drop_incomplete",
    f"WITH {tb.CUSTOMER_GRID_SQL} SELECT custkey, date, {rs('y')}, n FROM cgrid WHERE y IS NOT NULL AND n IS NOT NULL",
)
def drop_incomplete(spark, folder):
    grid = prepare.calendar_fill(tb.customer_series(spark, folder), CUST)
    return prepare.drop_incomplete(grid, ["y", "n"]).drop("is_gap")


@query(
    "null_out_nonpositive",
    f"""WITH bal AS (
          SELECT n_name AS nation, c_custkey, c_acctbal AS y FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT nation, c_custkey, {r('CASE WHEN y > 0 THEN y END', 'y')}, COALESCE(y <= 0, FALSE) AS was_nonpositive
        FROM bal""",
)
def null_out_nonpositive(spark, folder):
    customers = read_table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    nations = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = customers.join(nations, "c_nationkey").select("nation", "c_custkey", F.col("c_acctbal").alias("y"))
    return prepare.null_out_nonpositive(rows, SeriesSpec(keys=("nation",)))


def ingest(spark, folder) -> DataFrame:
    """Raw order rows as an ingest log: several rows per (customer, month), order key as sequence."""
    raw = read_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return raw.select(
        F.col("o_custkey").alias("custkey"), F.trunc("o_orderdate", "MM").alias("date"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("y"),
    )


INGEST_SQL = """
raw AS (SELECT o_custkey AS custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               o_orderkey AS seq, o_totalprice AS y FROM orders)
"""


@query(
    "dedupe_keep_last",
    f"""WITH {INGEST_SQL} SELECT custkey, date, seq, {rs('y')} FROM (
        SELECT *, row_number() OVER (PARTITION BY custkey, date ORDER BY seq DESC) AS k FROM raw) WHERE k = 1""",
)
def dedupe_keep_last(spark, folder):
    return prepare.dedupe_keep_last(ingest(spark, folder), CUST, "seq")


@query(
    "rollup_losses",
    """SELECT COUNT(*) AS facts, COUNT(*) - COUNT(o_orderdate) AS undated,
        COUNT(*) FILTER (o_orderdate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')) AS unmatched
        FROM orders""",
)
def rollup_losses(spark, folder):
    """Orders that a roll-up over one segment's customers would leave out."""
    customers = read_table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return rollup.rollup_losses(tb.orders(spark, folder), "o_orderdate", customers, ("o_custkey", "c_custkey"))


@query(
    "cleaning_report",
    f"""WITH {INGEST_SQL},
        per AS (SELECT custkey, date, COUNT(*) AS c, COUNT(*) FILTER (y <= 0) AS np, COUNT(*) FILTER (y IS NULL) AS nu
                FROM raw GROUP BY 1, 2)
        SELECT custkey, CAST(SUM(c) AS BIGINT) AS original_rows, CAST(SUM(c - 1) AS BIGINT) AS duplicates_removed,
               CAST(SUM(np) AS BIGINT) AS nonpositive, CAST(SUM(nu) AS BIGINT) AS nulls,
               CAST(date_diff('month', MIN(date), MAX(date)) + 1 AS BIGINT) AS rows_after,
               CAST(date_diff('month', MIN(date), MAX(date)) + 1 - COUNT(*) AS BIGINT) AS missing_after,
               CAST(date_diff('month', MIN(date), MAX(date)) + 1 - COUNT(*) AS BIGINT) AS missing_periods
        FROM per GROUP BY 1""",
)
def cleaning_report(spark, folder):
    raw = ingest(spark, folder)
    last = prepare.dedupe_keep_last(raw, CUST, "seq")
    return prepare.cleaning_report(raw, prepare.calendar_fill(last, CUST), CUST)


@query("calendar_fill", f"WITH {tb.CUSTOMER_GRID_SQL} SELECT custkey, date, {rs('y')}, n, is_gap FROM cgrid")
def calendar_fill(spark, folder):
    return prepare.calendar_fill(tb.customer_series(spark, folder), CUST)


@query(
    "calendar_fill_zero",
    f"WITH {tb.CUSTOMER_GRID_SQL} SELECT custkey, date, {r('COALESCE(y, 0.0)', 'y')}, n, is_gap FROM cgrid",
)
def calendar_fill_zero(spark, folder):
    return prepare.calendar_fill(tb.customer_series(spark, folder), CUST, fill="zero")


@query("missing_periods", f"WITH {tb.CUSTOMER_GRID_SQL} SELECT custkey, date FROM cgrid WHERE is_gap")
def missing_periods(spark, folder):
    return prepare.missing_periods(tb.customer_series(spark, folder), CUST)


@query(
    "future_calendar",
    f"""WITH {tb.CUSTOMER_SQL}, last AS (SELECT custkey, MAX(date) AS d FROM cust GROUP BY 1)
        SELECT custkey, CAST(s AS BIGINT) AS step, CAST(d + to_months(CAST(s AS INTEGER)) AS DATE) AS date
        FROM last, range(1, 13) t(s)""",
)
def future_calendar(spark, folder):
    return prepare.future_calendar(tb.customer_series(spark, folder), CUST, 12)


# -- joins -------------------------------------------------------------------

ANOM_SQL = f"""WITH {tb.CUSTOMER_SQL},
st AS (SELECT *, AVG(y) OVER (PARTITION BY custkey) AS m, STDDEV_POP(y) OVER (PARTITION BY custkey) AS s FROM cust),
an AS (SELECT custkey, date FROM st WHERE s > 0 AND ABS(y - m) / s > 2.5)
"""


def scored_customers(spark, folder):
    return anomaly.zscore_pop(tb.customer_series(spark, folder).drop("n"), CUST)


@query("exclude_anomalies", f"{ANOM_SQL} SELECT custkey, date, {rs('y')} FROM cust ANTI JOIN an USING (custkey, date)")
def exclude_anomalies(spark, folder):
    series = tb.customer_series(spark, folder).drop("n")
    marked = scored_customers(spark, folder).where("is_anomaly_zscore")
    return prepare.exclude_anomalies(series, marked, CUST)


@query("only_anomalies", f"{ANOM_SQL} SELECT custkey, date, {rs('y')} FROM cust SEMI JOIN an USING (custkey, date)")
def only_anomalies(spark, folder):
    series = tb.customer_series(spark, folder).drop("n")
    marked = scored_customers(spark, folder).where("is_anomaly_zscore")
    return prepare.only_anomalies(series, marked, CUST)


@query(
    "flag_join",
    f"""{ANOM_SQL} SELECT custkey, date, {rs('y')},
        EXISTS (SELECT 1 FROM an WHERE an.custkey = cust.custkey AND an.date = cust.date) AS is_anomaly FROM cust""",
)
def flag_join(spark, folder):
    series = tb.customer_series(spark, folder).drop("n")
    marked = scored_customers(spark, folder).where("is_anomaly_zscore")
    return prepare.flag_join(series, marked, CUST)


@query(
    "union_anomalies",
    f"""{ANOM_SQL},
        q AS (SELECT custkey, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM cust GROUP BY 1),
        iq AS (SELECT custkey, date FROM cust JOIN q USING (custkey)
               WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))
        SELECT custkey, date FROM an UNION SELECT custkey, date FROM iq""",
)
def union_anomalies(spark, folder):
    series = tb.customer_series(spark, folder).drop("n")
    by_z = anomaly.zscore_pop(series, CUST).where("is_anomaly_zscore").select("custkey", "date")
    by_iqr = anomaly.iqr_bounds(series, CUST).where("is_anomaly_iqr").select("custkey", "date")
    return prepare.union_anomalies(by_z, by_iqr)


# -- imputation --------------------------------------------------------------


def customer_grid(spark, folder):
    return prepare.calendar_fill(tb.customer_series(spark, folder).drop("n"), CUST).drop("is_gap")


BACK = "(PARTITION BY custkey ORDER BY date ROWS UNBOUNDED PRECEDING)"
AHEAD = "(PARTITION BY custkey ORDER BY date DESC ROWS UNBOUNDED PRECEDING)"


def impute_sql(value: str) -> str:
    return f"WITH {tb.CUSTOMER_GRID_SQL} SELECT custkey, date, {r(value, 'y')}, is_gap AS imputed FROM cgrid"


@query("impute_forward", impute_sql(f"last_value(y IGNORE NULLS) OVER {BACK}"))
def impute_forward(spark, folder):
    return prepare.impute_forward(customer_grid(spark, folder), CUST)


@query("impute_backward", impute_sql(f"last_value(y IGNORE NULLS) OVER {AHEAD}"))
def impute_backward(spark, folder):
    return prepare.impute_backward(customer_grid(spark, folder), CUST)


@query("impute_mean", impute_sql("COALESCE(y, AVG(y) OVER (PARTITION BY custkey))"))
def impute_mean(spark, folder):
    return prepare.impute_mean(customer_grid(spark, folder), CUST)


@query("impute_median", impute_sql("COALESCE(y, MEDIAN(y) OVER (PARTITION BY custkey))"))
def impute_median(spark, folder):
    return prepare.impute_median(customer_grid(spark, folder), CUST)


LINEAR_SQL = f"""WITH {tb.CUSTOMER_GRID_SQL},
near AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER {BACK} AS pi,
                last_value(y IGNORE NULLS) OVER {BACK} AS py,
                last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER {AHEAD} AS ni,
                last_value(y IGNORE NULLS) OVER {AHEAD} AS ny FROM cgrid),
lin AS (SELECT custkey, date, is_gap, COALESCE(y, py + (ny - py) / (ni - pi) * (i - pi)) AS y FROM near)
"""


@query("impute_linear", f"{LINEAR_SQL} SELECT custkey, date, {rs('y')}, is_gap AS imputed FROM lin")
def impute_linear(spark, folder):
    return prepare.impute_linear(customer_grid(spark, folder), CUST)


# second derivatives of the natural spline: the tridiagonal system forward, then backward
SPLINE_SQL = f"""WITH RECURSIVE {tb.CUSTOMER_GRID_SQL},
kn AS (SELECT custkey, i AS x, y, row_number() OVER w - 1 AS k, COUNT(*) OVER (PARTITION BY custkey) AS m,
              i - LAG(i) OVER w AS hl, LEAD(i) OVER w - i AS hr, y - LAG(y) OVER w AS dl, LEAD(y) OVER w - y AS dr
       FROM cgrid WHERE y IS NOT NULL WINDOW w AS (PARTITION BY custkey ORDER BY i)),
kc AS (SELECT *, k > 0 AND k < m - 1 AS inner_row FROM kn),
ke AS (SELECT custkey, k, m, x, y, hr, CASE WHEN inner_row THEN hl ELSE 0 END AS low, CASE WHEN inner_row THEN 2e0 * (hl + hr) ELSE 1e0 END AS mid,
              CASE WHEN inner_row THEN hr ELSE 0 END AS up, CASE WHEN inner_row THEN 6 * (dr / hr - dl / hl) ELSE 0e0 END AS rhs FROM kc),
fw AS (SELECT custkey, k, mid, rhs, up FROM ke WHERE k = 0
       UNION ALL
       SELECT ke.custkey, ke.k, ke.mid - ke.low / fw.mid * fw.up, ke.rhs - ke.low / fw.mid * fw.rhs, ke.up
       FROM fw JOIN ke ON ke.custkey = fw.custkey AND ke.k = fw.k + 1),
ft AS (SELECT fw.*, ke.m FROM fw JOIN ke ON ke.custkey = fw.custkey AND ke.k = fw.k),
bw AS (SELECT custkey, k, rhs / mid AS z FROM ft WHERE k = m - 1
       UNION ALL
       SELECT ft.custkey, ft.k, (ft.rhs - ft.up * bw.z) / ft.mid FROM bw JOIN ft ON ft.custkey = bw.custkey AND ft.k = bw.k - 1),
sg AS (SELECT ke.custkey, ke.x AS x0, ke.x + ke.hr AS x1, ke.hr AS h, ke.y AS y0, LEAD(ke.y) OVER w AS y1, bw.z AS z0, LEAD(bw.z) OVER w AS z1
       FROM ke JOIN bw ON bw.custkey = ke.custkey AND bw.k = ke.k WINDOW w AS (PARTITION BY ke.custkey ORDER BY ke.k)),
sp AS (SELECT c.custkey, c.date, c.y IS NULL AS imputed, CASE WHEN c.y IS NOT NULL THEN c.y
              ELSE z0 * pow(x1 - c.i, 3) / (6 * h) + z1 * pow(c.i - x0, 3) / (6 * h) + (y0 / h - z0 * h / 6) * (x1 - c.i) + (y1 / h - z1 * h / 6) * (c.i - x0) END AS y
       FROM cgrid c LEFT JOIN sg ON c.y IS NULL AND sg.custkey = c.custkey AND c.i > sg.x0 AND c.i < sg.x1)
"""


@query("impute_spline", f"{SPLINE_SQL} SELECT custkey, date, {rs('y')}, imputed FROM sp")
def impute_spline(spark, folder):
    return prepare.impute_spline(customer_grid(spark, folder), CUST)


@query(
    "impute_report",
    f"""WITH {tb.CUSTOMER_GRID_SQL}
        SELECT custkey, CASE WHEN COUNT(*) FILTER (is_gap) = 0 THEN 'none' ELSE 'interpolate' END AS method,
               COUNT(*) FILTER (is_gap) AS missing_before, CAST(0 AS BIGINT) AS missing_after,
               COUNT(*) FILTER (is_gap) AS values_imputed,
               COALESCE(array_to_string(list_slice(list(strftime(date, '%Y-%m') ORDER BY date) FILTER (is_gap), 1, 5), ','), '')
                 AS imputed_dates
        FROM cgrid GROUP BY 1""",
)
def impute_report(spark, folder):
    filled = prepare.impute(customer_grid(spark, folder), CUST, "interpolate")
    return prepare.impute_report(filled, CUST)


# -- validation --------------------------------------------------------------


@query(
    "validate_schema",
    f"""WITH {tb.LINE_SQL}
        SELECT FALSE AS valid, 'value_crores' AS missing_columns, COUNT(*) AS row_count,
               strftime(MIN(date), '%Y-%m') AS start, strftime(MAX(date), '%Y-%m') AS "end" FROM line""",
)
def validate_schema(spark, folder):
    return prepare.validate_schema(tb.line_series(spark, folder), tb.LINE, ["date", "y", "value_crores"])


QUALITY_SQL = f"""WITH {INGEST_SQL},
steps AS (SELECT *, LAG(date) OVER (PARTITION BY custkey ORDER BY seq) AS before FROM raw)
SELECT custkey, COUNT(*) AS total_records, COUNT(*) FILTER (y IS NULL) AS missing_values,
       COUNT(*) FILTER (y <= 0) AS nonpositive_values,
       COUNT(*) - COUNT(DISTINCT y) AS duplicate_values,
       {r('AVG(y)', 'mean')}, {r('MIN(y)', 'min')}, {r('MAX(y)', 'max')},
       strftime(MIN(date), '%Y-%m') AS start, strftime(MAX(date), '%Y-%m') AS "end",
       CAST(100 - 10 * (CAST(COUNT(*) FILTER (y IS NULL) > 0 AS INT) + CAST(COUNT(*) FILTER (y <= 0) > 0 AS INT)
            + CAST(COUNT(*) > COUNT(DISTINCT y) AS INT)) AS BIGINT) AS quality_score,
       COUNT(*) FILTER (date < before) AS order_violations, COUNT(*) FILTER (date < before) = 0 AS is_ordered
FROM steps GROUP BY 1"""


@query("data_quality", QUALITY_SQL)
def data_quality(spark, folder):
    return prepare.data_quality(ingest(spark, folder), CUST, "seq")


# -- flagship ----------------------------------------------------------------


def guard(fn: str, w: int, frame: str | None = None) -> str:
    over = f"OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN {frame or f'{w} PRECEDING AND 1 PRECEDING'})"
    return f"CASE WHEN COUNT(y) {over} = {w} THEN {fn} {over} END"


def year_of_history(spec: SeriesSpec):
    rolling = features.rolling_stats(spec, [12], median=False)
    return {k: rolling[k] for k in ("rolling_mean_12", "rolling_std_12")}


@query(
    "segment_overview",
    f"""WITH {tb.SEGMENT_GRID_SQL},
        f AS (SELECT segment, date, y,
              LAG(y, 1) OVER w AS lag_1, LAG(y, 12) OVER w AS lag_12,
              {guard('AVG(y)', 12)} AS rolling_mean_12, {guard('STDDEV_SAMP(y)', 12)} AS rolling_std_12,
              AVG(y) OVER (PARTITION BY segment) AS m, STDDEV_POP(y) OVER (PARTITION BY segment) AS s
              FROM g WINDOW w AS (PARTITION BY segment ORDER BY date)),
        z AS (SELECT *, CASE WHEN s > 0 THEN ABS(y - m) / s ELSE 0 END AS z_score FROM f)
        SELECT segment, date, {rs('y', 'lag_1', 'lag_12', 'rolling_mean_12', 'rolling_std_12', 'z_score')},
               z_score > 2.5 AS is_anomaly_zscore,
               CASE WHEN z_score > 3.5 THEN 'critical' WHEN z_score > 3 THEN 'high' WHEN z_score > 2.5 THEN 'medium'
                    WHEN z_score > 2 THEN 'low' ELSE 'normal' END AS severity FROM z""",
)
def segment_overview(spark, folder):
    featured = features.with_features(
        tb.segment_grid(spark, folder).drop("n"), SEG, lambda spec: features.lag_features(spec, [1, 12]), year_of_history
    )
    return anomaly.zscore_pop(featured, SEG)
