"""Result analytics (ANL-*), limits (LIM-*) and chart points (CHT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.functions.exprs import money, month_index, month_of, total
from martlet.operators import charts as C
from martlet.operators import insights as I
from martlet.operators import limits as L
from martlet.operators import rollups as R
from martlet.operators import star as S
from martlet.session import Warehouse
from martlet.suite.registry import register
from martlet.suite.sales import _SEG_SQL, money_sum_sql, r6


def txt2(x: str) -> str:
    """Oracle twin of ``insights.round2_text``."""
    two = f"CAST(CAST(ROUND(CAST({x} AS DOUBLE) * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS DECIMAL(38,2)) AS VARCHAR)"
    return f"regexp_replace({two}, '0$', '')"


MONTHLY_SQL = f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {money_sum_sql('o_totalprice')} AS total_revenue
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""


def _monthly(spark, sf):
    return R.monthly_trend(Warehouse(spark, sf).orders, "o_orderdate", "o_totalprice", as_money=True)


def _segments(spark, sf):
    wh = Warehouse(spark, sf)
    return S.aov_by_segment(wh.orders, wh.customer)


def _per_customer(spark, sf):
    o = Warehouse(spark, sf).orders
    return (o.groupBy("o_custkey")
            .agg(total(F.sum(money("o_totalprice"))).alias("total_spend"),
                 F.count(F.lit(1)).alias("orders")))


PER_CUSTOMER_SQL = f"""SELECT o_custkey, {money_sum_sql('o_totalprice')} AS total_spend, COUNT(*) AS orders
FROM orders GROUP BY o_custkey"""

PRIMARY_SQL = f"""
WITH t AS ({_SEG_SQL}), top AS (SELECT * FROM t ORDER BY orders DESC, c_mktsegment LIMIT 1)
SELECT 'primary' AS kind, c_mktsegment AS label, 'orders' AS metric, CAST(orders AS DOUBLE) AS value,
       'The strongest result is `' || c_mktsegment || '` with `orders` = `' || {txt2('orders')} || '`.' AS message
FROM top"""

ANOMALY_SQL = f"""
WITH t AS ({MONTHLY_SQL}),
     s AS (SELECT COUNT(*) AS n, AVG(CAST(total_revenue AS DOUBLE)) AS mu,
                  STDDEV_POP(CAST(total_revenue AS DOUBLE)) AS sd FROM t),
     z AS (SELECT month, CAST(total_revenue AS DOUBLE) AS v, (CAST(total_revenue AS DOUBLE) - mu) / sd AS z, n, sd
           FROM t, s),
     b AS (SELECT * FROM z ORDER BY ABS(z) DESC, month LIMIT 1)
SELECT 'anomaly' AS kind, month AS label, 'total_revenue' AS metric, v AS value, {r6('z')} AS z_score,
       'Potential anomaly detected: `' || month || '` deviates sharply on `total_revenue` with a z-score of `'
       || {txt2('z')} || '`.' AS message
FROM b WHERE n >= 5 AND sd <> 0 AND ABS(z) >= 1.75"""

TREND_SQL = f"""
WITH t AS ({MONTHLY_SQL}),
     a AS (SELECT COUNT(*) AS n, arg_min(month, month) AS fp, arg_min(CAST(total_revenue AS DOUBLE), month) AS fv,
                  arg_max(month, month) AS lp, arg_max(CAST(total_revenue AS DOUBLE), month) AS lv FROM t),
     d AS (SELECT *, (lv - fv) * 100.0 / fv AS delta FROM a)
SELECT 'trend' AS kind, fp AS first_period, lp AS last_period, fv AS baseline, lv AS latest,
       {r6('delta')} AS delta_pct, CASE WHEN delta >= 0 THEN 'upward' ELSE 'downward' END AS direction,
       'The time series shows an overall ' || CASE WHEN delta >= 0 THEN 'upward' ELSE 'downward' END
       || ' movement of `' || {txt2('delta')} || '%` from first to latest period.' AS message
FROM d WHERE n >= 3 AND fv <> 0"""


@register("insight_primary", PRIMARY_SQL)
def insight_primary(spark, sf):
    return I.primary_signal(_segments(spark, sf), order_col="c_mktsegment")


@register("insight_anomaly", ANOMALY_SQL)
def insight_anomaly(spark, sf):
    return I.detect_anomaly(_monthly(spark, sf), order_col="month")


@register("zscore_rows", f"""
WITH s AS (SELECT AVG(COALESCE(value, 0.0)) AS mu, STDDEV_POP(COALESCE(value, 0.0)) AS sd FROM events)
SELECT event_id, value, {r6('(COALESCE(value, 0.0) - mu) / sd')} AS z_score
FROM events, s WHERE ABS((COALESCE(value, 0.0) - mu) / sd) >= 1.75""")
def zscore_rows(spark, sf):
    return S.zscore_rows(Warehouse(spark, sf).events, "value", ["event_id"])


@register("insight_trend", TREND_SQL)
def insight_trend(spark, sf):
    return I.detect_trend(_monthly(spark, sf))


@register("insight_cluster_ready", f"""
SELECT 'cluster' AS kind, 2 AS numeric_columns, COUNT(*) AS rows,
       '{fixed.CLUSTER_MESSAGE}' AS message
FROM ({PER_CUSTOMER_SQL}) t HAVING COUNT(*) >= 12""")
def insight_cluster_ready(spark, sf):
    return I.cluster_ready(_per_customer(spark, sf).select("total_spend", "orders"))


@register("insights_all", f"""
SELECT 1 AS position, kind, message FROM ({PRIMARY_SQL.replace(_SEG_SQL, MONTHLY_SQL)
    .replace('ORDER BY orders DESC, c_mktsegment', 'ORDER BY total_revenue DESC, month')
    .replace("c_mktsegment AS label, 'orders' AS metric, CAST(orders AS DOUBLE)",
             "month AS label, 'total_revenue' AS metric, CAST(total_revenue AS DOUBLE)")
    .replace("'The strongest result is `' || c_mktsegment || '` with `orders` = `' || " + txt2('orders'),
             "'The strongest result is `' || month || '` with `total_revenue` = `' || " + txt2('total_revenue'))})
UNION ALL SELECT 2, kind, message FROM ({ANOMALY_SQL})
UNION ALL SELECT 3, kind, message FROM ({TREND_SQL})""")
def insights_all(spark, sf):
    return I.insights(_monthly(spark, sf), intent="trend", order_col="month")


def _spread(spark, sf):
    """Order values with a NaN and a missing one: both count as 0 in a z-score
    and are left out of everything else."""
    ev = Warehouse(spark, sf).events
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") != "signup", F.col("value"))
    return ev.groupBy("user_id").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n")), ev.withColumn("value", v)


@register("zscore_with_gaps", f"""
WITH e AS (SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value END AS v,
                  CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value FROM events),
     s AS (SELECT AVG(v) AS mu, STDDEV_POP(v) AS sd FROM e)
SELECT event_id, value, {r6('(v - mu) / sd')} AS z_score FROM e, s WHERE ABS((v - mu) / sd) >= 1.75""")
def zscore_with_gaps(spark, sf):
    out = S.zscore_rows(_spread(spark, sf)[1], "value", ["event_id"])
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@register("distribution_with_gaps", f"""
WITH e AS (SELECT CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS v FROM events)
SELECT COUNT(v) AS n, MIN(v) AS min_value, MAX(v) AS max_value, {r6('AVG(v)')} AS mean_value,
       {r6('STDDEV_POP(v)')} AS stddev_value, {r6('QUANTILE_CONT(v, 0.25)')} AS p25,
       {r6('QUANTILE_CONT(v, 0.5)')} AS median, {r6('QUANTILE_CONT(v, 0.75)')} AS p75 FROM e""")
def distribution_with_gaps(spark, sf):
    return R.distribution(_spread(spark, sf)[1], "value")


@register("insights_segmentation", f"""
WITH t AS ({PER_CUSTOMER_SQL}), top AS (SELECT * FROM t ORDER BY o_custkey DESC LIMIT 1),
     s AS (SELECT AVG(CAST(o_custkey AS DOUBLE)) AS mu, STDDEV_POP(CAST(o_custkey AS DOUBLE)) AS sd, COUNT(*) AS n FROM t),
     z AS (SELECT total_spend, o_custkey, (CAST(o_custkey AS DOUBLE) - mu) / sd AS z, n, sd FROM t, s),
     b AS (SELECT * FROM z ORDER BY ABS(z) DESC, o_custkey LIMIT 1)
SELECT 1 AS position, 'primary' AS kind, 'The strongest result is `' || CAST(total_spend AS VARCHAR)
       || '` with `o_custkey` = `' || {txt2('o_custkey')} || '`.' AS message FROM top
UNION ALL
SELECT 2, 'anomaly', 'Potential anomaly detected: `' || CAST(total_spend AS VARCHAR)
       || '` deviates sharply on `o_custkey` with a z-score of `' || {txt2('z')} || '`.'
FROM b WHERE n >= 5 AND sd <> 0 AND ABS(z) >= 1.75
UNION ALL
SELECT 4, 'cluster', '{fixed.CLUSTER_MESSAGE}' FROM t HAVING COUNT(*) >= 12""")
def insights_segmentation(spark, sf):
    return I.insights(_per_customer(spark, sf), intent="segmentation", order_col="o_custkey")


@register("insights_empty", f"""
SELECT 1 AS position, 'empty' AS kind, '{fixed.EMPTY_MESSAGE}' AS message
FROM (SELECT COUNT(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0""")
def insights_empty(spark, sf):
    none = Warehouse(spark, sf).orders.where("o_totalprice < 0")
    return I.insights(R.monthly_trend(none, "o_orderdate", "o_totalprice", as_money=True), "trend", "month")


@register("moving_average_3m", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month,
                  CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS idx,
                  {money_sum_sql('o_totalprice')} AS revenue
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)
SELECT a.month, a.revenue, {r6('CAST(SUM(b.revenue) AS DOUBLE) / COUNT(*)')} AS moving_avg,
       COUNT(*) AS window_periods
FROM t a JOIN t b ON b.idx BETWEEN a.idx - 2 AND a.idx GROUP BY a.month, a.revenue""")
def moving_average_3m(spark, sf):
    series = S.monthly_revenue_series(Warehouse(spark, sf).orders)
    return I.moving_average(series, "month", "month_idx", "revenue", 3)


@register("cluster_customers")
def cluster_customers(spark, sf):
    wh = Warehouse(spark, sf)
    feats = (_per_customer(spark, sf)
             .join(wh.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
             .select("c_custkey", F.col("total_spend").cast("double").alias("total_spend"),
                     F.col("orders").cast("double").alias("orders"), "c_acctbal"))
    return I.cluster_entities(feats, "c_custkey", ["total_spend", "orders", "c_acctbal"], k=4)


@register("cluster_segments", f"""
WITH f AS (SELECT c_custkey, c_acctbal + 1000000 * (c_custkey % 4) AS balance, CAST(c_custkey % 4 AS DOUBLE) AS level FROM customer)
SELECT CAST(c_custkey % 4 + 1 AS INTEGER) AS segment, COUNT(*) AS entities, {r6('AVG(balance)')} AS mean_balance,
       {r6('AVG(level)')} AS mean_level
FROM f GROUP BY c_custkey % 4""")
def cluster_segments(spark, sf):
    """Customers in four segments far apart, found again by k-means."""
    c = Warehouse(spark, sf).customer
    feats = c.select("c_custkey", (F.col("c_acctbal") + 1_000_000 * (F.col("c_custkey") % 4)).alias("balance"),
                     (F.col("c_custkey") % 4).cast("double").alias("level"))
    return I.cluster_summary(I.cluster_entities(feats, "c_custkey", ["balance", "level"], k=4), ["balance", "level"])


@register("moving_average_with_gaps", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS idx,
                  CASE WHEN month(o_orderdate) % 5 <> 0 THEN SUM(CAST(o_totalprice AS DECIMAL(12,2))) / 1e9 END AS share
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY month, idx, month(o_orderdate))
SELECT a.month, a.share, {r6('SUM(b.share) / COUNT(b.share)')} AS moving_avg, COUNT(*) AS window_periods
FROM t a JOIN t b ON b.idx BETWEEN a.idx - 2 AND a.idx GROUP BY a.month, a.share""")
def moving_average_with_gaps(spark, sf):
    """Values far below a cent, some months without any."""
    series = S.monthly_revenue_series(Warehouse(spark, sf).orders)
    share = F.when(F.substring("month", 6, 2).cast("int") % 5 != 0, F.col("revenue").cast("double") / F.lit(1e9))
    return I.moving_average(series.withColumn("share", share).select("month", "month_idx", "share"), "month", "month_idx", "share", 3)


# ---------------------------------------------------------------- limits

@register("limit_wrapped", f"SELECT * FROM ({MONTHLY_SQL} ORDER BY month) LIMIT 5")
def limit_wrapped(spark, sf):
    return L.limited(_monthly(spark, sf), 5)


@register("capped_result", """
SELECT *, (SELECT COUNT(*) > 10000 FROM orders) AS overflow
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000)""")
def capped_result(spark, sf):
    return L.capped(Warehouse(spark, sf).orders.orderBy("o_orderkey"), 10000)


@register("preview_result", f"SELECT * FROM ({PER_CUSTOMER_SQL}) ORDER BY o_custkey LIMIT {fixed.PREVIEW_ROWS}")
def preview_result(spark, sf):
    return L.preview_rows(_per_customer(spark, sf).orderBy("o_custkey"))


# ---------------------------------------------------------------- charts

@register("chart_points_bar", f"""
SELECT 'bar' AS chart_type, 'c_mktsegment' AS x_field, 'orders' AS y_field, c_mktsegment AS x,
       CAST(orders AS DOUBLE) AS y FROM ({_SEG_SQL})""")
def chart_points_bar(spark, sf):
    return C.chart_points(_segments(spark, sf))


@register("chart_points_scatter", f"""
SELECT 'scatter' AS chart_type, 'total_spend' AS x_field, 'orders' AS y_field, total_spend AS x,
       CAST(orders AS DOUBLE) AS y FROM ({PER_CUSTOMER_SQL})""")
def chart_points_scatter(spark, sf):
    return C.chart_points(_per_customer(spark, sf).select("total_spend", "orders"), hint="scatter")


@register("chart_line_points", f"""
WITH s AS (SELECT COUNT(*) AS n, COUNT(DISTINCT ts) AS u FROM events)
SELECT 'line' AS chart_type, 'ts' AS x_field, 'value' AS y_field, strftime(ts, '%Y-%m') AS x,
       {r6('SUM(value)')} AS y FROM events, s WHERE n > 50 AND n = u GROUP BY 4
UNION ALL
SELECT 'line', 'ts', 'value', CAST(ts AS VARCHAR), {r6('value')} FROM events, s WHERE NOT (n > 50 AND n = u)""")
def chart_line_points(spark, sf):
    return C.chart_points(Warehouse(spark, sf).events.select("ts", "value"))


@register("chart_line_raw", f"""
WITH s AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderdate) AS u FROM orders)
SELECT 'line' AS chart_type, 'o_orderdate' AS x_field, 'o_totalprice' AS y_field,
       strftime(o_orderdate, '%Y-%m') AS x, {r6('SUM(o_totalprice)')} AS y
FROM orders, s WHERE n > 50 AND n = u GROUP BY 4
UNION ALL
SELECT 'line', 'o_orderdate', 'o_totalprice', CAST(o_orderdate AS VARCHAR), {r6('o_totalprice')}
FROM orders, s WHERE NOT (n > 50 AND n = u)""")
def chart_line_raw(spark, sf):
    return C.chart_points(Warehouse(spark, sf).orders.select("o_orderdate", "o_totalprice"))


@register("chart_bar_points", f"""
SELECT 'bar' AS chart_type, 'p_brand' AS x_field, 'total_revenue' AS y_field, p_brand AS x,
       CAST(total_revenue AS DOUBLE) AS y
FROM (SELECT p_brand, {money_sum_sql('p_retailprice')} AS total_revenue FROM part GROUP BY p_brand
      ORDER BY total_revenue DESC, p_brand LIMIT 20)""")
def chart_bar_points(spark, sf):
    by_brand = R.top_n(Warehouse(spark, sf).part, "p_brand", "p_retailprice", None, as_money=True)
    return C.chart_points(by_brand, hint="bar", sample=fixed.CHART_SAMPLE_ROWS,
                          order=[F.col("total_revenue").desc(), F.col("p_brand")])


@register("chart_table", """
SELECT 'table' AS chart_type, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def chart_table(spark, sf):
    wh = Warehouse(spark, sf)
    named = wh.nation.join(wh.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return C.chart_points(named.select("n_name", "r_name"))


@register("chart_month_names", f"""
SELECT 'line' AS chart_type, 'month_name' AS x_field, 'revenue' AS y_field, strftime(o_orderdate, '%B') AS x,
       {r6('SUM(o_totalprice) / 1000')} AS y FROM orders GROUP BY 4""")
def chart_month_names(spark, sf):
    """Month names are no dates: a line over them keeps its rows."""
    o = Warehouse(spark, sf).orders
    by_name = o.groupBy(F.date_format("o_orderdate", "MMMM").alias("month_name")).agg(
        (F.sum("o_totalprice") / 1000).alias("revenue"))
    return C.chart_points(by_name)
