"""Templates (AGG-*) and star-join questions (Q-*) over the warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions.exprs import money, total
from martlet.operators import rollups as R
from martlet.operators import star as S
from martlet.session import Warehouse
from martlet.suite.registry import register

# SQL fragments shared by the oracles (DuckDB dialect)
REV = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
RET = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def r6(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE) * 1e6) / 1e6"


def money_sum_sql(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(12,2))) AS DECIMAL(38,2))"


# ---------------------------------------------------------------- AGG-1..11

@register("top_n_parts", f"""
SELECT p_brand, {money_sum_sql('p_retailprice')} AS total_revenue
FROM part GROUP BY p_brand ORDER BY total_revenue DESC, p_brand LIMIT 10""")
def top_n_parts(spark, sf):
    return R.top_n(Warehouse(spark, sf).part, "p_brand", "p_retailprice", 10, as_money=True)


@register("monthly_trend", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {money_sum_sql('o_totalprice')} AS total_revenue
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1""")
def monthly_trend(spark, sf):
    return R.monthly_trend(Warehouse(spark, sf).orders, "o_orderdate", "o_totalprice", as_money=True)


@register("count_by_returnflag", """
SELECT l_returnflag, COUNT(*) AS record_count FROM lineitem
GROUP BY l_returnflag ORDER BY record_count DESC, l_returnflag""")
def count_by_returnflag(spark, sf):
    return R.count_by(Warehouse(spark, sf).lineitem, "l_returnflag")


@register("segment_breakdown", f"""
SELECT o_orderstatus, COUNT(*) AS orders, {money_sum_sql('o_totalprice')} AS revenue,
       {r6("AVG(CAST(o_totalprice AS DECIMAL(12,2)))")} AS avg_value
FROM orders GROUP BY o_orderstatus""")
def segment_breakdown(spark, sf):
    return R.segment_breakdown(Warehouse(spark, sf).orders, "o_orderstatus", "o_totalprice", as_money=True)


@register("generic_rollup", f"""
SELECT l_linestatus, {money_sum_sql('l_extendedprice')} AS total, COUNT(*) AS records
FROM lineitem GROUP BY l_linestatus""")
def generic_rollup(spark, sf):
    return R.generic_rollup(Warehouse(spark, sf).lineitem, "l_linestatus", "l_extendedprice", as_money=True)


# Rates with many decimals and gaps: sums and averages follow the column's type
# and skip what is missing (a NaN counts as missing).
RATES_SQL = """SELECT l_returnflag, l_shipdate, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount / 7 END AS rate
FROM lineitem"""


def _rates(spark, sf):
    li = Warehouse(spark, sf).lineitem
    gap = F.when(F.col("l_orderkey") % 2 == 0, F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    return li.select("l_returnflag", "l_shipdate",
                     F.when(F.col("l_linenumber") == 1, gap).otherwise(F.col("l_discount") / 7).alias("rate"))


@register("rates_top", f"""
SELECT l_returnflag, {r6('SUM(rate)')} AS total_revenue FROM ({RATES_SQL}) GROUP BY l_returnflag""")
def rates_top(spark, sf):
    return R.top_n(_rates(spark, sf), "l_returnflag", "rate", None)


@register("rates_trend", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS month, {r6('SUM(rate)')} AS total_revenue FROM ({RATES_SQL}) GROUP BY 1""")
def rates_trend(spark, sf):
    return R.monthly_trend(_rates(spark, sf), "l_shipdate", "rate")


@register("rates_breakdown", f"""
SELECT l_returnflag, COUNT(*) AS orders, {r6('SUM(rate)')} AS revenue, {r6('AVG(rate)')} AS avg_value
FROM ({RATES_SQL}) GROUP BY l_returnflag""")
def rates_breakdown(spark, sf):
    return R.segment_breakdown(_rates(spark, sf), "l_returnflag", "rate")


@register("rates_average", f"""
SELECT l_returnflag, {r6('AVG(rate)')} AS avg_value FROM ({RATES_SQL}) GROUP BY l_returnflag""")
def rates_average(spark, sf):
    return R.avg_by(_rates(spark, sf), "l_returnflag", "rate")


@register("counts_rollup", """
SELECT p_type, CAST(SUM(p_size) AS BIGINT) AS total, COUNT(*) AS records FROM part GROUP BY p_type""")
def counts_rollup(spark, sf):
    return R.generic_rollup(Warehouse(spark, sf).part, "p_type", "p_size")


@register("segment_aov_gaps", f"""
WITH o AS (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT c_mktsegment, COUNT(*) AS orders, {money_sum_sql('price')} AS revenue,
       {r6('AVG(CAST(price AS DECIMAL(12,2)))')} AS avg_order_value
FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def segment_aov_gaps(spark, sf):
    wh = Warehouse(spark, sf)
    priced = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return S.aov_by_segment(wh.orders.withColumn("o_totalprice", priced), wh.customer)


@register("top_orders_by_value", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_orders_by_value(spark, sf):
    return R.top_rows(Warehouse(spark, sf).orders, "o_totalprice", "o_orderkey", 10)


@register("monthly_count", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS record_count
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def monthly_count(spark, sf):
    return R.monthly_count(Warehouse(spark, sf).orders, "o_orderdate")


@register("avg_by_priority", f"""
SELECT o_orderpriority, {r6(f"CAST({money_sum_sql('o_totalprice')} AS DOUBLE) / COUNT(o_totalprice)")} AS avg_value
FROM orders GROUP BY o_orderpriority""")
def avg_by_priority(spark, sf):
    return R.avg_by(Warehouse(spark, sf).orders, "o_orderpriority", "o_totalprice", as_money=True)


@register("value_distribution", f"""
SELECT COUNT(l_extendedprice) AS n, MIN(l_extendedprice) AS min_value, MAX(l_extendedprice) AS max_value,
       {r6('AVG(l_extendedprice)')} AS mean_value, {r6('STDDEV_POP(l_extendedprice)')} AS stddev_value,
       {r6('QUANTILE_CONT(l_extendedprice, 0.25)')} AS p25, {r6('QUANTILE_CONT(l_extendedprice, 0.5)')} AS median,
       {r6('QUANTILE_CONT(l_extendedprice, 0.75)')} AS p75
FROM lineitem""")
def value_distribution(spark, sf):
    return R.distribution(Warehouse(spark, sf).lineitem, "l_extendedprice")


@register("distribution_by_flag", f"""
SELECT l_returnflag, l_linenumber, COUNT(l_extendedprice) AS n, MIN(l_extendedprice) AS min_value, MAX(l_extendedprice) AS max_value,
       {r6('AVG(l_extendedprice)')} AS mean_value, {r6('STDDEV_POP(l_extendedprice)')} AS stddev_value,
       {r6('QUANTILE_CONT(l_extendedprice, 0.25)')} AS p25, {r6('QUANTILE_CONT(l_extendedprice, 0.5)')} AS median,
       {r6('QUANTILE_CONT(l_extendedprice, 0.75)')} AS p75
FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def distribution_by_flag(spark, sf):
    return R.distribution_by(Warehouse(spark, sf).lineitem, ["l_returnflag", "l_linenumber"], "l_extendedprice")


@register("value_histogram", """
WITH b AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events)
SELECT CAST(LEAST(FLOOR((value - lo) * 10 / (hi - lo)) + 1, 10) AS INTEGER) AS bucket,
       COUNT(*) AS n, MIN(value) AS bucket_min, MAX(value) AS bucket_max
FROM events, b WHERE value IS NOT NULL GROUP BY 1""")
def value_histogram(spark, sf):
    return R.histogram(Warehouse(spark, sf).events, "value", 10)


@register("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_orders(spark, sf):
    return R.preview(Warehouse(spark, sf).orders, "o_orderkey", 10)


@register("trend_one_year", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {money_sum_sql('o_totalprice')} AS total_revenue
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY 1""")
def trend_one_year(spark, sf):
    o = Warehouse(spark, sf).orders
    return R.monthly_trend(R.in_year(o, "o_orderdate", 1998), "o_orderdate", "o_totalprice", as_money=True)


@register("top_parts_last_month", f"""
WITH m AS (SELECT date_trunc('month', MAX(l_shipdate)) AS s FROM lineitem)
SELECT p_name, CAST(SUM({REV}) AS DECIMAL(38,2)) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey, m
WHERE l_shipdate >= m.s AND l_shipdate < m.s + INTERVAL 1 MONTH
GROUP BY p_name ORDER BY total_revenue DESC, p_name LIMIT 10""")
def top_parts_last_month(spark, sf):
    wh = Warehouse(spark, sf)
    return S.top_products(R.last_month_of(wh.lineitem, "l_shipdate"), wh.part, 10)


@register("trend_one_category", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(SUM({REV}) AS DECIMAL(38,2)) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type = 'ECONOMY' AND l_shipdate IS NOT NULL GROUP BY 1""")
def trend_one_category(spark, sf):
    wh = Warehouse(spark, sf)
    items = wh.lineitem.join(wh.part.filter(F.col("p_type") == "ECONOMY").select("p_partkey"),
                             F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return (items.filter(F.col("l_shipdate").isNotNull())
            .groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
            .agg(total(F.sum(S.line_revenue())).alias("total_revenue")).orderBy("month"))


# ---------------------------------------------------------------- Q-1..18

@register("q_top_products", f"""
SELECT p_name, CAST(SUM({REV}) AS DECIMAL(38,2)) AS total_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY total_revenue DESC, p_name LIMIT 10""")
def q_top_products(spark, sf):
    wh = Warehouse(spark, sf)
    return S.top_products(wh.lineitem, wh.part, 10)


_GEO_JOIN = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


@register("q_return_rate_by_region", f"""
SELECT r_name, COUNT(*) AS items, CAST(SUM({RET}) AS BIGINT) AS returned,
       {r6(f'CAST(SUM({RET}) AS DOUBLE) / COUNT(*)')} AS return_rate
{_GEO_JOIN} GROUP BY r_name""")
def q_return_rate_by_region(spark, sf):
    wh = Warehouse(spark, sf)
    return S.return_rate_by_region(wh.lineitem, wh.orders, wh.customer, wh.nation, wh.region)


@register("q_return_anomaly_by_region", f"""
WITH t AS (SELECT n_name, r_name, COUNT(*) AS items, CAST(SUM({RET}) AS BIGINT) AS returned,
                  CAST(SUM({RET}) AS DOUBLE) / COUNT(*) AS rate
           {_GEO_JOIN} GROUP BY n_name, r_name),
     s AS (SELECT AVG(rate) AS mu, STDDEV_POP(rate) AS sd FROM t)
SELECT n_name, r_name, items, returned, {r6('rate')} AS return_rate,
       {r6('(rate - mu) / sd')} AS z_score, ABS((rate - mu) / sd) >= 1.75 AS is_anomaly
FROM t, s""")
def q_return_anomaly_by_region(spark, sf):
    wh = Warehouse(spark, sf)
    return S.return_anomaly_by_nation(wh.lineitem, wh.orders, wh.customer, wh.nation, wh.region)


@register("q_revenue_by_channel", f"""
SELECT o_orderpriority, {money_sum_sql('o_totalprice')} AS revenue, COUNT(*) AS orders
FROM orders GROUP BY o_orderpriority""")
def q_revenue_by_channel(spark, sf):
    return S.revenue_by_channel(Warehouse(spark, sf).orders)


@register("q_order_value_outliers", f"""
WITH t AS (SELECT l_orderkey, {money_sum_sql('l_extendedprice')} AS order_total FROM lineitem GROUP BY l_orderkey),
     s AS (SELECT AVG(CAST(order_total AS DOUBLE)) AS mu, STDDEV_POP(CAST(order_total AS DOUBLE)) AS sd FROM t)
SELECT l_orderkey, order_total, {r6('(CAST(order_total AS DOUBLE) - mu) / sd')} AS z_score
FROM t, s WHERE ABS((CAST(order_total AS DOUBLE) - mu) / sd) >= 1.75""")
def q_order_value_outliers(spark, sf):
    return S.order_value_outliers(Warehouse(spark, sf).lineitem)


_SEG_SQL = f"""
SELECT c_mktsegment, COUNT(*) AS orders, {money_sum_sql('o_totalprice')} AS revenue,
       {r6(f"CAST({money_sum_sql('o_totalprice')} AS DOUBLE) / COUNT(o_totalprice)")} AS avg_order_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@register("q_aov_by_segment", _SEG_SQL)
def q_aov_by_segment(spark, sf):
    wh = Warehouse(spark, sf)
    return S.aov_by_segment(wh.orders, wh.customer)


@register("q_segment_revenue_aov", _SEG_SQL + " ORDER BY revenue DESC")
def q_segment_revenue_aov(spark, sf):
    wh = Warehouse(spark, sf)
    return S.aov_by_segment(wh.orders, wh.customer)


@register("q_top_customers", f"""
SELECT c_custkey, c_name, {money_sum_sql('o_totalprice')} AS total_spend
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY total_spend DESC, c_custkey LIMIT 10""")
def q_top_customers(spark, sf):
    wh = Warehouse(spark, sf)
    return S.top_customers(wh.orders, wh.customer, 10)


@register("q_january_returns_by_type", """
SELECT p_type, COUNT(*) AS returns FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND month(l_shipdate) = 1 GROUP BY p_type""")
def q_january_returns_by_type(spark, sf):
    wh = Warehouse(spark, sf)
    return S.returns_by_category_in_month(wh.lineitem, wh.part, 1)


@register("q_aov_by_part_type", f"""
WITH t AS (SELECT p_type, l_orderkey, SUM({REV}) AS rev
           FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
           GROUP BY p_type, l_orderkey)
SELECT p_type, CAST(SUM(rev) AS DECIMAL(38,2)) AS revenue, COUNT(*) AS orders,
       {r6('CAST(CAST(SUM(rev) AS DECIMAL(38,2)) AS DOUBLE) / COUNT(*)')} AS avg_order_value
FROM t GROUP BY p_type""")
def q_aov_by_part_type(spark, sf):
    wh = Warehouse(spark, sf)
    return S.aov_by_category(wh.lineitem, wh.orders, wh.part)


@register("q_trend_by_channel", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority,
       {money_sum_sql('o_totalprice')} AS revenue, COUNT(*) AS orders
FROM orders GROUP BY 1, 2""")
def q_trend_by_channel(spark, sf):
    return S.trend_by_dim(Warehouse(spark, sf).orders, "o_orderpriority")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_NAMES = ["urgent", "high", "medium", "not_specified", "low"]


@register("q_trend_pivot", "SELECT strftime(o_orderdate, '%Y-%m') AS month, " + ", ".join(
    f"CAST(SUM(CASE WHEN o_orderpriority = '{v}' THEN CAST(o_totalprice AS DECIMAL(12,2)) END) "
    f"AS DECIMAL(38,2)) AS {n}" for v, n in zip(PRIORITIES, PRIORITY_NAMES))
    + " FROM orders GROUP BY 1")
def q_trend_pivot(spark, sf):
    return S.trend_pivot(Warehouse(spark, sf).orders, "o_orderpriority", PRIORITIES, PRIORITY_NAMES)


@register("q_sales_and_return_rate", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(SUM({REV}) AS DECIMAL(38,2)) AS revenue,
       COUNT(*) AS items, CAST(SUM({RET}) AS BIGINT) AS returned,
       {r6(f'CAST(SUM({RET}) AS DOUBLE) / COUNT(*)')} AS return_rate
FROM lineitem GROUP BY 1""")
def q_sales_and_return_rate(spark, sf):
    return S.sales_and_return_rate(Warehouse(spark, sf).lineitem)


_POP = """
SELECT a.{p}, a.revenue, b.revenue AS previous_value,
       {g} AS growth_pct
FROM t a LEFT JOIN t b ON a.idx = b.idx + 1"""


@register("q_month_over_month", f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month,
                  CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS idx,
                  {money_sum_sql('o_totalprice')} AS revenue
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)"""
    + _POP.format(p="month", g=r6("CAST(a.revenue - b.revenue AS DOUBLE) * 100 / CAST(b.revenue AS DOUBLE)")))
def q_month_over_month(spark, sf):
    return S.month_over_month(Warehouse(spark, sf).orders)


@register("q_quarter_over_quarter", f"""
WITH t AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
                  year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS idx,
                  {money_sum_sql('o_totalprice')} AS revenue
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)"""
    + _POP.format(p="quarter", g=r6("CAST(a.revenue - b.revenue AS DOUBLE) * 100 / CAST(b.revenue AS DOUBLE)")))
def q_quarter_over_quarter(spark, sf):
    return S.quarter_over_quarter(Warehouse(spark, sf).orders)


@register("q_overrepresentation", f"""
WITH c AS (SELECT r_name, c_mktsegment, COUNT(*) AS orders
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment),
     g AS (SELECT c_mktsegment, SUM(orders) AS seg FROM c GROUP BY c_mktsegment),
     r AS (SELECT r_name, SUM(orders) AS reg FROM c GROUP BY r_name),
     a AS (SELECT SUM(orders) AS total_orders FROM c),
     x AS (SELECT c.r_name, c.c_mktsegment, c.orders,
                  CAST(c.orders AS DOUBLE) / CAST(r.reg AS DOUBLE) AS sir,
                  CAST(g.seg AS DOUBLE) / CAST(a.total_orders AS DOUBLE) AS so
           FROM c JOIN g USING (c_mktsegment) JOIN r USING (r_name), a)
SELECT r_name, c_mktsegment, orders, {r6('sir')} AS share_in_region, {r6('so')} AS share_overall,
       {r6('sir / so')} AS lift FROM x""")
def q_overrepresentation(spark, sf):
    wh = Warehouse(spark, sf)
    return S.overrepresentation(wh.orders, wh.customer, wh.nation, wh.region)


@register("q_anomaly_by_channel", f"""
WITH t AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month,
                  {money_sum_sql('o_totalprice')} AS revenue FROM orders GROUP BY 1, 2),
     z AS (SELECT *, (CAST(revenue AS DOUBLE) - AVG(CAST(revenue AS DOUBLE)) OVER (PARTITION BY o_orderpriority))
                     / STDDEV_POP(CAST(revenue AS DOUBLE)) OVER (PARTITION BY o_orderpriority) AS zz FROM t)
SELECT o_orderpriority, month, revenue, {r6('zz')} AS z_score, ABS(zz) >= 1.75 AS is_anomaly FROM z""")
def q_anomaly_by_channel(spark, sf):
    return S.anomaly_by_dim(Warehouse(spark, sf).orders, "o_orderpriority")


@register("q_rollup_month_region", f"""
SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS order_year, {money_sum_sql('o_totalprice')} AS revenue,
       CAST(GROUPING_ID(r_name, year(o_orderdate)) AS BIGINT) AS grouping_level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, year(o_orderdate))""")
def q_rollup_month_region(spark, sf):
    wh = Warehouse(spark, sf)
    return S.rollup_month_region(wh.orders, wh.customer, wh.nation, wh.region)


@register("q_star_wide", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
       l_returnflag, strftime(o_orderdate, '%Y-%m') AS order_month, o_orderpriority,
       c_custkey, c_name, c_mktsegment, n_name, r_name, p_name, p_type, p_brand, s_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def q_star_wide(spark, sf):
    wh = Warehouse(spark, sf)
    return S.star_wide(wh.lineitem, wh.orders, wh.customer, wh.nation, wh.region, wh.part, wh.supplier)
