"""Star-join questions over the fact and dimension tables.

Plan shape used throughout: aggregate the fact table down to the grain of
the next join key *before* joining (eager aggregation; Catalyst does not push
an aggregate below a join by itself). Each step shrinks the data, the partial
aggregate combines a hot key map-side, and the joins run on keys that are
unique on the dimension side. Only dimensions whose row count has been
proven small are broadcast (``broadcast_if_bounded``); the rest are left to
Catalyst's size estimate and AQE.

Stand-ins for the driver tables: items = ``lineitem``, returns = items with
``l_returnflag = 'R'``, channel = ``o_orderpriority``, segment/tier =
``c_mktsegment``, category = ``p_type``, region = customer's nation's region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.exprs import (
    mean_of, money, month_index, month_of, nan_to_null, quarter_of, ratio, round6, total,
)
from martlet.plans.hot_keys import hot_join
from martlet.plans.joins import broadcast_if_bounded


def line_revenue() -> Column:
    """Net line revenue, exact: price x (1 - discount) in decimals."""
    return money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))


def is_return() -> Column:
    return (F.col("l_returnflag") == F.lit("R")).cast("int")


def _geo(nation: DataFrame, region: DataFrame) -> DataFrame:
    """nation -> region name; both are bounded dimension tables."""
    return (broadcast_if_bounded(nation.select("n_nationkey", "n_name", "n_regionkey"))
            .join(broadcast_if_bounded(region.select("r_regionkey", "r_name")),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name"))


def top_products(lineitem: DataFrame, part: DataFrame, n: int = 10,
                 dim: str = "p_name") -> DataFrame:
    """Q-1: top products by net revenue."""
    per_part = (lineitem.groupBy("l_partkey")
                .agg(F.sum(line_revenue()).alias("_rev")))
    return (per_part.join(part.select("p_partkey", dim), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(dim).agg(total(F.sum("_rev")).alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc(), F.col(dim)).limit(n))


def _items_per_nation(lineitem, orders, customer) -> DataFrame:
    per_order = (lineitem.groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("items"), F.sum(is_return()).alias("returned")))
    per_cust = (orders.select("o_orderkey", "o_custkey")
                .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
                .groupBy("o_custkey")
                .agg(F.sum("items").alias("items"), F.sum("returned").alias("returned")))
    return (customer.select("c_custkey", "c_nationkey")
            .join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
            .groupBy("c_nationkey")
            .agg(F.sum("items").alias("items"), F.sum("returned").alias("returned")))


def return_rate_by_region(lineitem, orders, customer, nation, region) -> DataFrame:
    """Q-3: share of items returned per region, highest first."""
    per_nation = _items_per_nation(lineitem, orders, customer)
    return (per_nation.join(_geo(nation, region), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("r_name")
            .agg(F.sum("items").cast("bigint").alias("items"),
                 F.sum("returned").cast("bigint").alias("returned"))
            .withColumn("return_rate", round6(ratio("returned", "items")))
            .orderBy(F.col("return_rate").desc(), "r_name"))


def return_anomaly_by_nation(lineitem, orders, customer, nation, region,
                             threshold: float = 1.75) -> DataFrame:
    """Q-10: return rate per nation, z-score across nations, flag."""
    per_nation = _items_per_nation(lineitem, orders, customer)
    rates = (per_nation.join(_geo(nation, region), F.col("c_nationkey") == F.col("n_nationkey"))
             .select("n_name", "r_name", F.col("items").cast("bigint").alias("items"),
                     F.col("returned").cast("bigint").alias("returned"),
                     ratio("returned", "items").alias("_rate")))
    stats = rates.select(F.struct(F.avg("_rate").alias("mu"),
                                  F.stddev_pop("_rate").alias("sd"))).scalar()
    mu, sd = stats["mu"], stats["sd"]
    z = F.try_divide(F.col("_rate") - mu, sd)
    return rates.select("n_name", "r_name", "items", "returned",
                        round6("_rate").alias("return_rate"), round6(z).alias("z_score"),
                        (F.abs(z) >= threshold).alias("is_anomaly"))


def revenue_by_channel(orders: DataFrame) -> DataFrame:
    """Q-4: order revenue and count per channel."""
    return (orders.groupBy("o_orderpriority")
            .agg(total(F.sum(money("o_totalprice"))).alias("revenue"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy(F.col("revenue").desc(), "o_orderpriority"))


def order_totals(lineitem: DataFrame) -> DataFrame:
    return (lineitem.groupBy("l_orderkey")
            .agg(total(F.sum(money("l_extendedprice"))).alias("order_total")))


def zscore_rows(df: DataFrame, value: str, keep: list[str], threshold: float = 1.75,
                only_outliers: bool = True) -> DataFrame:
    """Row-form z-score of ``value`` over the whole frame. Mean and population
    stddev are one-row scalar subqueries (no global window, no cross join);
    nulls count as 0 like the reference's fillna(0)."""
    v = F.coalesce(nan_to_null(F.col(value).cast("double")), F.lit(0.0))
    stats = df.select(F.struct(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))).scalar()
    mu, sd = stats["mu"], stats["sd"]
    z = F.try_divide(v - mu, F.when(sd != 0, sd))
    out = df.select(*keep, F.col(value), round6(z).alias("z_score"))
    if only_outliers:
        out = out.filter(F.abs(z) >= threshold)
    return out


def order_value_outliers(lineitem: DataFrame, threshold: float = 1.75) -> DataFrame:
    """Q-5: orders whose line total deviates by |z| >= threshold."""
    return zscore_rows(order_totals(lineitem), "order_total", ["l_orderkey"], threshold)


def _orders_per_customer(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("o_custkey")
            .agg(F.sum(money("o_totalprice")).alias("_rev"), F.count(F.lit(1)).alias("_n"),
                 F.count("o_totalprice").alias("_priced")))


def aov_by_segment(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Q-6 / Q-9: orders, revenue and average order value (over the orders that
    have one) per segment."""
    per_cust = _orders_per_customer(orders)
    return (customer.select("c_custkey", "c_mktsegment")
            .join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
            .groupBy("c_mktsegment")
            .agg(F.sum("_n").cast("bigint").alias("orders"), total(F.sum("_rev")).alias("revenue"),
                 mean_of(total(F.sum("_rev")), F.sum("_priced")).alias("avg_order_value"))
            .orderBy(F.col("revenue").desc(), "c_mktsegment"))


def top_customers(orders: DataFrame, customer: DataFrame, n: int = 10) -> DataFrame:
    """Q-7: top-k spenders; the top-k runs before the join, so only n rows
    meet the customer table."""
    spend = (orders.groupBy("o_custkey")
             .agg(total(F.sum(money("o_totalprice"))).alias("total_spend"))
             .orderBy(F.col("total_spend").desc(), "o_custkey").limit(n))
    return (spend.join(customer.select("c_custkey", "c_name"),
                       F.col("o_custkey") == F.col("c_custkey"))
            .select("c_custkey", "c_name", "total_spend")
            .orderBy(F.col("total_spend").desc(), "c_custkey"))


def returns_by_category_in_month(lineitem: DataFrame, part: DataFrame, month: int = 1) -> DataFrame:
    """Q-8: returned items per category in a calendar month (any year)."""
    per_part = (lineitem.filter((F.col("l_returnflag") == "R") & (F.month("l_shipdate") == month))
                .groupBy("l_partkey").agg(F.count(F.lit(1)).alias("_n")))
    return (per_part.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("p_type").agg(F.sum("_n").cast("bigint").alias("returns"))
            .orderBy(F.col("returns").desc(), "p_type"))


def aov_by_category(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Q-11: revenue per category over the number of distinct orders that
    bought it. The distinct count is a two-level aggregate: first to
    (category, order), then to category."""
    typed = (lineitem.select("l_orderkey", "l_partkey", line_revenue().alias("_r"))
             .transform(hot_join, part.select("p_partkey", "p_type"), "l_partkey", "p_partkey")
             .groupBy("p_type", "l_orderkey").agg(F.sum("_r").alias("_rev")))
    typed = typed.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"),
                       "left_semi")
    return (typed.groupBy("p_type")
            .agg(total(F.sum("_rev")).alias("revenue"), F.count(F.lit(1)).alias("orders"))
            .withColumn("avg_order_value", mean_of("revenue", "orders"))
            .orderBy(F.col("avg_order_value").desc(), "p_type"))


def trend_by_dim(orders: DataFrame, dim: str = "o_orderpriority") -> DataFrame:
    """Q-12: monthly revenue split by a dimension (long form)."""
    return (orders.groupBy(month_of("o_orderdate").alias("month"), dim)
            .agg(total(F.sum(money("o_totalprice"))).alias("revenue"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy("month", dim))


def trend_pivot(orders: DataFrame, dim: str, values: list[str], names: list[str]) -> DataFrame:
    """Q-12 wide form: one column per listed value (the list is given, so
    no extra job to discover the distinct values)."""
    wide = (orders.groupBy(month_of("o_orderdate").alias("month"))
            .pivot(dim, values).agg(total(F.sum(money("o_totalprice")))))
    for v, n in zip(values, names):
        wide = wide.withColumnRenamed(v, n)
    return wide.orderBy("month")


def sales_and_return_rate(lineitem: DataFrame) -> DataFrame:
    """Q-13: monthly revenue beside the monthly return rate (conditional
    aggregation in one pass)."""
    return (lineitem.groupBy(month_of("l_shipdate").alias("month"))
            .agg(total(F.sum(line_revenue())).alias("revenue"),
                 F.count(F.lit(1)).alias("items"),
                 F.sum(is_return()).cast("bigint").alias("returned"))
            .withColumn("return_rate", round6(ratio("returned", "items")))
            .orderBy("month"))


def period_over_period(series: DataFrame, period: str, index: str, value: str) -> DataFrame:
    """Q-14 / ANL-7: value beside the previous calendar period's value and the
    percent change. Each period is emitted for itself and for the next one and
    one ``groupBy`` on the index brings both together: the series is computed
    once, and there is no join and no global window."""
    v = F.col(value)
    emitted = series.select(F.explode(F.array(
        F.struct(F.col(index).alias("i"), F.lit(True).alias("own"), F.col(period).alias("p"), v.alias("v")),
        F.struct((F.col(index) + 1).alias("i"), F.lit(False).alias("own"), F.col(period).alias("p"), v.alias("v")),
    )).alias("e")).select("e.*")
    own = F.col("own")
    met = emitted.groupBy("i").agg(
        F.max(own).alias("own"), F.max(F.when(own, F.col("p"))).alias(period), F.max(F.when(own, F.col("v"))).alias(value),
        F.max(F.when(~own, F.col("v"))).alias("previous_value"))
    return (met.where("own")
            .select(period, value, "previous_value",
                    round6(F.try_divide((F.col(value) - F.col("previous_value")).cast("double") * 100,
                                        F.col("previous_value").cast("double"))).alias("growth_pct"))
            .orderBy(period))


def monthly_revenue_series(orders: DataFrame) -> DataFrame:
    return (orders.filter(F.col("o_orderdate").isNotNull())
            .groupBy(month_of("o_orderdate").alias("month"),
                     month_index("o_orderdate").alias("month_idx"))
            .agg(total(F.sum(money("o_totalprice"))).alias("revenue")))


def month_over_month(orders: DataFrame) -> DataFrame:
    return period_over_period(monthly_revenue_series(orders), "month", "month_idx", "revenue")


def quarter_over_quarter(orders: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    series = (orders.filter(d.isNotNull())
              .groupBy(quarter_of(d).alias("quarter"),
                       (F.year(d) * 4 + F.quarter(d) - 1).alias("quarter_idx"))
              .agg(total(F.sum(money("o_totalprice"))).alias("revenue")))
    return period_over_period(series, "quarter", "quarter_idx", "revenue")


def overrepresentation(orders, customer, nation, region) -> DataFrame:
    """Q-15: per region and segment, the segment's share of the region's
    orders divided by its share of all orders (lift > 1 = over-represented).
    Region totals come from a window partitioned by region (a handful of
    rows per partition); segment totals from a groupBy joined back."""
    per_cust = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"))
    per_nat_seg = (customer.select("c_custkey", "c_nationkey", "c_mktsegment")
                   .join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
                   .groupBy("c_nationkey", "c_mktsegment").agg(F.sum("_n").alias("_n")))
    cells = (per_nat_seg.join(_geo(nation, region), F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("r_name", "c_mktsegment").agg(F.sum("_n").cast("bigint").alias("orders")))
    seg = cells.groupBy("c_mktsegment").agg(F.sum("orders").alias("_seg"))
    reg = cells.groupBy("r_name").agg(F.sum("orders").alias("_reg"))
    all_orders = cells.select(F.sum("orders")).scalar()
    out = (cells.join(seg, "c_mktsegment").join(reg, "r_name")
           .withColumn("share_in_region", ratio("orders", "_reg"))
           .withColumn("share_overall", ratio("_seg", all_orders)))
    return out.select("r_name", "c_mktsegment", "orders",
                      round6("share_in_region").alias("share_in_region"),
                      round6("share_overall").alias("share_overall"),
                      round6(F.try_divide(F.col("share_in_region"), F.col("share_overall"))).alias("lift"))


def anomaly_by_dim(orders: DataFrame, dim: str = "o_orderpriority",
                   threshold: float = 1.75) -> DataFrame:
    """Q-16: monthly revenue per dimension value, z-score within each value.
    The window is partitioned by the dimension, and sees one row per month."""
    from pyspark.sql import Window
    series = (orders.groupBy(dim, month_of("o_orderdate").alias("month"))
              .agg(total(F.sum(money("o_totalprice"))).alias("revenue")))
    w = Window.partitionBy(dim)
    v = F.col("revenue").cast("double")
    z = F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w))
    return (series.withColumn("_z", z)
            .select(dim, "month", "revenue", round6("_z").alias("z_score"),
                    (F.abs(F.col("_z")) >= threshold).alias("is_anomaly")))


def rollup_month_region(orders, customer, nation, region) -> DataFrame:
    """Q-17: revenue by (region, year) with subtotals: ROLLUP + grouping_id.
    Orders are pre-aggregated per (customer, year) before the joins."""
    per_cust_year = (orders.groupBy("o_custkey", F.year("o_orderdate").alias("order_year"))
                     .agg(F.sum(money("o_totalprice")).alias("_rev")))
    per_nat = (customer.select("c_custkey", "c_nationkey")
               .join(per_cust_year, F.col("c_custkey") == F.col("o_custkey"))
               .groupBy("c_nationkey", "order_year").agg(F.sum("_rev").alias("_rev")))
    return (per_nat.join(_geo(nation, region), F.col("c_nationkey") == F.col("n_nationkey"))
            .rollup("r_name", "order_year")
            .agg(total(F.sum("_rev")).alias("revenue"), F.grouping_id().alias("grouping_level")))


def star_wide(lineitem, orders, customer, nation, region, part, supplier) -> DataFrame:
    """Q-18: each item with its order, customer, geography, part and
    supplier attributes. Join order matters at scale (no cost-based
    reordering by default): the order side is widened first (orders x
    customer x geography, ten times fewer rows than items), so the item
    table is shuffled once on the order key instead of being re-shuffled on
    the customer key after the fact-to-fact join. Parts and suppliers that very
    many items share are joined apart (``hot_join``)."""
    geo = _geo(nation, region)
    cust = (customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    wide_orders = (orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
                   .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    return (lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                            "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
            .transform(hot_join, part.select("p_partkey", "p_name", "p_type", "p_brand"), "l_partkey", "p_partkey")
            .transform(hot_join, supplier.select("s_suppkey", "s_name"), "l_suppkey", "s_suppkey")
            .join(wide_orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_returnflag",
                    month_of("o_orderdate").alias("order_month"), "o_orderpriority",
                    "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name",
                    "p_name", "p_type", "p_brand", "s_name"))
