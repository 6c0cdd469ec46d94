"""Data rules of the retail seeder (XF-*) applied to the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.functions.exprs import date_key, money, month_of
from martlet.operators import star as S
from martlet.operators import transforms as X
from martlet.plans.hot_keys import hot_join
from martlet.plans.joins import broadcast_if_bounded
from martlet.session import Warehouse
from martlet.suite.registry import register
from martlet.suite.sales import money_sum_sql

CAL_SQL = """
WITH s AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders),
     d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS full_date FROM s),
     cal AS (
SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_id, full_date,
       CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter,
       CAST(month(full_date) AS INTEGER) AS month, strftime(full_date, '%B') AS month_name,
       CAST(strftime(full_date, '%U') AS INTEGER) AS week, CAST(day(full_date) AS INTEGER) AS day,
       strftime(full_date, '%A') AS day_name, dayofweek(full_date) IN (0, 6) AS is_weekend FROM d)"""

MULT_SQL = "CASE {m} " + " ".join(
    f"WHEN {i} THEN CAST({v} AS DECIMAL(4,2))" for i, v in enumerate(fixed.MONTH_MULTIPLIERS, 1)
) + " ELSE CAST(1.00 AS DECIMAL(4,2)) END"


@register("date_dimension", CAL_SQL + " SELECT * FROM cal")
def date_dimension(spark, sf):
    return X.calendar(Warehouse(spark, sf).orders, "o_orderdate")


@register("date_key_join", CAL_SQL + f"""
SELECT day_name, is_weekend, COUNT(*) AS orders, {money_sum_sql('o_totalprice')} AS revenue
FROM orders JOIN cal ON CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) = cal.date_id
GROUP BY day_name, is_weekend""")
def date_key_join(spark, sf):
    o = Warehouse(spark, sf).orders
    cal = broadcast_if_bounded(X.calendar(o, "o_orderdate").select("date_id", "day_name", "is_weekend"))
    per_day = (o.groupBy(date_key("o_orderdate").alias("_k"))
               .agg(F.count(F.lit(1)).alias("_n"), F.sum(money("o_totalprice")).alias("_r")))
    return (per_day.join(cal, F.col("_k") == F.col("date_id"))
            .groupBy("day_name", "is_weekend")
            .agg(F.sum("_n").cast("bigint").alias("orders"), F.sum("_r").cast("decimal(38,2)").alias("revenue")))


@register("size_band", """
SELECT CASE WHEN p_size < 25 THEN '18-24' WHEN p_size < 35 THEN '25-34' WHEN p_size < 45 THEN '35-44'
            WHEN p_size < 55 THEN '45-54' ELSE '55+' END AS size_band, COUNT(*) AS parts
FROM part GROUP BY 1""")
def size_band(spark, sf):
    return (Warehouse(spark, sf).part.groupBy(X.band("p_size").alias("size_band"))
            .agg(F.count(F.lit(1)).alias("parts")))


@register("seasonal_adjusted", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {money_sum_sql('o_totalprice')} AS revenue,
       {MULT_SQL.format(m='month(o_orderdate)')} AS multiplier,
       CAST(ROUND({money_sum_sql('o_totalprice')} * {MULT_SQL.format(m='month(o_orderdate)')}, 2) AS DECIMAL(38,2))
         AS adjusted_revenue
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, month(o_orderdate)""")
def seasonal_adjusted(spark, sf):
    o = Warehouse(spark, sf).orders
    per = (o.filter(F.col("o_orderdate").isNotNull())
           .groupBy(month_of("o_orderdate").alias("month"), F.month("o_orderdate").alias("_m"))
           .agg(F.sum(money("o_totalprice")).cast("decimal(38,2)").alias("revenue")))
    mult = X.seasonal_multiplier("_m")
    return per.select("month", "revenue", mult.alias("multiplier"),
                      X.round_money(F.col("revenue") * mult).alias("adjusted_revenue"))


def _price_lines(wh):
    lines = (wh.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
             .transform(hot_join, wh.part.select("p_partkey", "p_type"), "l_partkey", "p_partkey")
             .join(wh.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"),
                   F.col("l_orderkey") == F.col("o_orderkey")))
    m = F.month("o_orderdate")
    cols = X.price_line("l_extendedprice", "l_discount",
                        (F.col("p_type") == "PROMO") & m.isin(11, 12),
                        F.col("o_orderpriority") == "1-URGENT", m)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey",
                        money("l_extendedprice").alias("line_price"),
                        cols[0].cast("decimal(6,4)").alias("discount_rate"), *cols[1:],
                        m.alias("order_month"))


_RATE_SQL = ("CAST(CAST(l_discount AS DECIMAL(6,4)) "
             "+ CASE WHEN p_type = 'PROMO' AND month(o_orderdate) IN (11, 12) THEN 0.08 ELSE 0 END "
             "+ CASE WHEN o_orderpriority = '1-URGENT' THEN 0.05 ELSE 0 END AS DECIMAL(6,4))")
PRICE_SQL = f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS line_price,
                  {_RATE_SQL} AS discount_rate, CAST(month(o_orderdate) AS INTEGER) AS order_month
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
     b AS (SELECT *, CAST(ROUND(line_price * LEAST(discount_rate, CAST(0.35 AS DECIMAL(6,4))), 2) AS DECIMAL(38,2))
                     AS discount_amount FROM a),
     c AS (SELECT *, CAST(ROUND(line_price - discount_amount, 2) AS DECIMAL(38,2)) AS net_amount FROM b),
     pl AS (SELECT l_orderkey, l_linenumber, l_partkey, line_price, discount_rate, discount_amount, net_amount,
                  CAST(ROUND(net_amount * {MULT_SQL.format(m='order_month')}, 2) AS DECIMAL(38,2)) AS adjusted_net,
                  order_month FROM c)"""


@register("price_lines", PRICE_SQL + " SELECT * FROM pl")
def price_lines(spark, sf):
    return _price_lines(Warehouse(spark, sf))


@register("rollup_orders", PRICE_SQL + f""",
     r AS (SELECT l_orderkey, SUM(line_price) AS sub, SUM(discount_amount) AS disc, MAX(order_month) AS m
           FROM pl GROUP BY l_orderkey),
     s AS (SELECT l_orderkey, CAST(ROUND(sub * {MULT_SQL.format(m='m')}, 2) AS DECIMAL(38,2)) AS subtotal,
                  CAST(ROUND(disc * {MULT_SQL.format(m='m')}, 2) AS DECIMAL(38,2)) AS discount_amount FROM r)
SELECT l_orderkey, subtotal, discount_amount,
       CAST(ROUND((subtotal - discount_amount) * CAST(0.075 AS DECIMAL(5,3)), 2) AS DECIMAL(38,2)) AS tax_amount,
       CAST(0 AS DECIMAL(38,2)) AS shipping_amount,
       CAST(subtotal - discount_amount + ROUND((subtotal - discount_amount) * CAST(0.075 AS DECIMAL(5,3)), 2)
            AS DECIMAL(38,2)) AS total_amount
FROM s""")
def rollup_orders(spark, sf):
    lines = _price_lines(Warehouse(spark, sf))
    return X.rollup_order(lines, "l_orderkey", "line_price", "discount_amount", "order_month")


@register("return_rate_rule", """
WITH l AS (SELECT r_name, CAST(0.045 + CASE WHEN p_type = 'LARGE' THEN 0.05 ELSE 0 END
                             + CASE WHEN r_name = 'AMERICA' THEN 0.01 ELSE 0 END
                             + CASE WHEN month(o_orderdate) = 1 THEN 0.03 ELSE 0 END AS DECIMAL(6,4)) AS p,
                  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ret
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           JOIN part ON l_partkey = p_partkey)
SELECT r_name, COUNT(*) AS items, CAST(SUM(p) AS DECIMAL(38,4)) AS expected_returns,
       CAST(SUM(ret) AS BIGINT) AS actual_returns FROM l GROUP BY r_name""")
def return_rate_rule(spark, sf):
    """Expected returns per region from the probability rule, beside the
    actual returns. Items are counted at the grain that determines their
    probability, (category?, region, January?), level by level: per order, per
    customer, per nation."""
    wh = Warehouse(spark, sf)
    counts = [F.sum(c).alias(c) for c in ("items", "returned")]
    per_order = (wh.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
                 .transform(hot_join, wh.part.select("p_partkey", "p_type"), "l_partkey", "p_partkey")
                 .groupBy("l_orderkey", (F.col("p_type") == "LARGE").alias("is_category"))
                 .agg(F.count(F.lit(1)).alias("items"), F.sum(S.is_return()).alias("returned")))
    january = F.when(F.month("o_orderdate") == 1, 1).otherwise(2)
    per_cust = (wh.orders.select("o_orderkey", "o_custkey", january.alias("month"))
                .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
                .groupBy("o_custkey", "is_category", "month").agg(*counts))
    per_nat = (wh.customer.select("c_custkey", "c_nationkey")
               .join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
               .groupBy("c_nationkey", "is_category", "month").agg(*counts))
    geo = S._geo(wh.nation, wh.region)
    chance = X.return_probability(F.col("is_category"), F.col("r_name") == "AMERICA", "month")
    return (per_nat.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name")
            .agg(F.sum("items").cast("bigint").alias("items"),
                 F.sum(F.col("items") * chance).cast("decimal(38,4)").alias("expected_returns"),
                 F.sum("returned").cast("bigint").alias("actual_returns")))


@register("return_amounts", """
SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.92 AS DECIMAL(4,2)), 2)
       AS DECIMAL(38,2)) AS return_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'P'""")
def return_amounts(spark, sf):
    wh = Warehouse(spark, sf)
    kept = wh.orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    returned = wh.lineitem.filter(F.col("l_returnflag") == "R")
    return (returned.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
            .select("l_orderkey", "l_linenumber", X.return_amount("l_extendedprice").alias("return_amount")))


@register("clamped_dates", """
WITH m AS (SELECT CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders)
SELECT l_orderkey, l_linenumber, LEAST(CAST(l_shipdate AS DATE) + 30, hi) AS return_date,
       CAST(l_shipdate AS DATE) + 30 > hi AS is_clamped
FROM lineitem, m WHERE l_returnflag = 'R'""")
def clamped_dates(spark, sf):
    wh = Warehouse(spark, sf)
    hi = wh.orders.select(F.max(F.to_date("o_orderdate"))).scalar()
    r = wh.lineitem.filter(F.col("l_returnflag") == "R")
    return r.select("l_orderkey", "l_linenumber", X.clamped_date("l_shipdate", 30, hi).alias("return_date"),
                    (F.date_add(F.to_date("l_shipdate"), 30) > hi).alias("is_clamped"))


@register("formatted_codes", """
SELECT 'part' AS kind, p_partkey AS key, printf('SKU-%05d', p_partkey) AS code FROM part
UNION ALL SELECT 'customer', c_custkey, printf('CUST-%06d', c_custkey) FROM customer
UNION ALL SELECT 'order', o_orderkey, printf('ORD-%08d', o_orderkey) FROM orders""")
def formatted_codes(spark, sf):
    wh = Warehouse(spark, sf)
    return (wh.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"),
                           X.code("SKU", "p_partkey", 5).alias("code"))
            .unionByName(wh.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"),
                                            X.code("CUST", "c_custkey", 6).alias("code")))
            .unionByName(wh.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"),
                                          X.code("ORD", "o_orderkey", 8).alias("code"))))
