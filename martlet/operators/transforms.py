"""Row transforms of the retail data rules as column expressions: calendar
dimension, date keys, bands, seasonal multipliers, line pricing, order
rollups, return probability and amounts, clamped dates and code formats.

Money arithmetic is done in decimals and rounded half away from zero, so
results do not depend on binary floating point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions import fixed
from martlet.functions.exprs import ColumnOrName, col, date_key, money

RATE = "decimal(6,4)"


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """XF-1: one row per day between the earliest and the latest ``ts`` of
    ``df``. The day list is generated from a one-row aggregate; its size is
    the calendar span (days), not the data size."""
    span = df.agg(F.min(F.to_date(F.col(ts))).alias("lo"), F.max(F.to_date(F.col(ts))).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
    return date_attributes(days, "full_date")


def date_attributes(days: DataFrame, d: str = "full_date") -> DataFrame:
    c = F.col(d)
    # %U: week of the year, weeks start on Sunday, days before the first
    # Sunday are week 0; dayofweek is 1 (Sunday) .. 7 (Saturday)
    week = F.floor((F.dayofyear(c) - 1 + 7 - (F.dayofweek(c) - 1)) / 7)
    return days.select(
        date_key(c).alias("date_id"), c.alias("full_date"), F.year(c).alias("year"),
        F.quarter(c).alias("quarter"), F.month(c).alias("month"),
        F.date_format(c, "MMMM").alias("month_name"), week.cast("int").alias("week"),
        F.dayofmonth(c).alias("day"), F.date_format(c, "EEEE").alias("day_name"),
        F.dayofweek(c).isin(1, 7).alias("is_weekend"))


def band(c: ColumnOrName, edges=fixed.AGE_BAND_EDGES, last: str = fixed.AGE_BAND_LAST) -> Column:
    """XF-3: first edge the value is below gives the label, else ``last``."""
    v = col(c)
    out = None
    for edge, label in edges:
        out = F.when(v < edge, F.lit(label)) if out is None else out.when(v < edge, F.lit(label))
    return out.otherwise(F.lit(last))


def seasonal_multiplier(month: ColumnOrName) -> Column:
    """XF-4: the month's multiplier as an exact decimal, 1.00 when unknown."""
    table = F.array(*[F.lit(str(m)).cast("decimal(4,2)") for m in fixed.MONTH_MULTIPLIERS])
    m = col(month)
    return F.when(m.between(1, 12), F.element_at(table, m.cast("int"))).otherwise(
        F.lit("1.00").cast("decimal(4,2)"))


def round_money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(38,2)")


def price_line(price: ColumnOrName, base_rate: ColumnOrName, bonus_category: Column,
               bonus_channel: Column, month: ColumnOrName) -> list[Column]:
    """XF-5: rate = base + 0.08 (category bonus) + 0.05 (channel bonus);
    discount = price x min(rate, 0.35); net = price - discount; the stored
    net is net x the month's multiplier. Returns (rate, discount, net,
    adjusted_net) columns."""
    p = money(price)
    rate = (col(base_rate).cast(RATE)
            + F.when(bonus_category, F.lit(str(fixed.ELECTRONICS_HOLIDAY_BONUS)).cast(RATE)).otherwise(0)
            + F.when(bonus_channel, F.lit(str(fixed.SOCIAL_BONUS)).cast(RATE)).otherwise(0))
    capped = F.least(rate, F.lit(str(fixed.DISCOUNT_CAP)).cast(RATE))
    discount = round_money(p * capped)
    net = round_money(p - discount)
    adjusted = round_money(net * seasonal_multiplier(month))
    return [rate.alias("discount_rate"), discount.alias("discount_amount"), net.alias("net_amount"),
            adjusted.alias("adjusted_net")]


def rollup_order(lines: DataFrame, key: str, price: str, discount: str, month: str,
                 shipping: ColumnOrName | None = None) -> DataFrame:
    """XF-6: per order, subtotal and discount scaled by the month multiplier,
    tax 7.5 % of the difference, total adds shipping. One groupBy."""
    ship = money(shipping) if shipping is not None else F.lit("0.00").cast("decimal(12,2)")
    per = (lines.groupBy(key)
           .agg(F.sum(money(price)).alias("_sub"), F.sum(money(discount)).alias("_disc"),
                F.max(col(month)).alias("_month"), F.max(ship).alias("shipping_amount")))
    mult = seasonal_multiplier("_month")
    sub = round_money(F.col("_sub") * mult)
    disc = round_money(F.col("_disc") * mult)
    tax = round_money((sub - disc) * F.lit(str(fixed.TAX_RATE)).cast("decimal(5,3)"))
    total = (sub - disc + tax + F.col("shipping_amount")).cast("decimal(38,2)")
    return per.select(key, sub.alias("subtotal"), disc.alias("discount_amount"), tax.alias("tax_amount"),
                      F.col("shipping_amount").cast("decimal(38,2)").alias("shipping_amount"),
                      total.alias("total_amount"))


def return_probability(is_category: Column, is_region: Column, month: ColumnOrName) -> Column:
    """XF-7: 0.045 + 0.05 (category) + 0.01 (region) + 0.03 (January)."""
    d = lambda x: F.lit(str(x)).cast(RATE)
    return (d(fixed.RETURN_BASE)
            + F.when(is_category, d(fixed.RETURN_APPAREL)).otherwise(0)
            + F.when(is_region, d(fixed.RETURN_WEST)).otherwise(0)
            + F.when(col(month) == 1, d(fixed.RETURN_JANUARY)).otherwise(0)).cast(RATE)


def return_amount(unit_price_times_qty: ColumnOrName) -> Column:
    """XF-8: price x quantity x 0.92, rounded to cents."""
    return round_money(money(unit_price_times_qty) * F.lit(str(fixed.RETURN_AMOUNT_FACTOR)).cast("decimal(4,2)"))


def clamped_date(d: ColumnOrName, days: int, latest: Column) -> Column:
    """XF-9: ``min(d + days, latest)``."""
    return F.least(F.date_add(F.to_date(col(d)), days), latest)


def code(prefix: str, key: ColumnOrName, width: int) -> Column:
    """``PREFIX-000123`` style codes."""
    return F.format_string(f"{prefix}-%0{width}d", col(key).cast("bigint"))
