"""Chart choice and chart-ready points.

The chart type and fields are chosen by rules over ``df.schema`` on the
driver; the points themselves are computed on Spark (``select``, one
aggregate for the line-collapse test, ``groupBy`` for the monthly collapse).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions import fixed
from martlet.functions.exprs import round6
from martlet.operators.insights import date_like_columns, numeric_columns


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    x_field: str | None = None
    y_field: str | None = None
    title: str = ""


# Chart kinds in order of preference: (kind, role of x, role of y, title).
CHART_RULES = (
    ("line", "date", "number", "Trend Overview"),
    ("bar", "other", "number", "Category Comparison"),
    ("scatter", "number", "second number", "Metric Relationship"),
)


def infer_chart(df: DataFrame, hint: str | None = None, question: str | None = None) -> ChartSpec:
    """CHT-1: the first rule of ``CHART_RULES`` whose two roles have a column;
    the rule named by ``hint`` goes first; a table if none applies. (Emptiness
    is checked by ``chart_points``, which needs the data.)"""
    numbers = numeric_columns(df)
    roles = {"date": date_like_columns(df), "number": numbers, "second number": numbers[1:],
             "other": [c for c in df.columns if c not in numbers]}
    first = {role: names[0] for role, names in roles.items() if names}
    usable = [r for r in CHART_RULES if r[1] in first and r[2] in first]
    if not usable:
        return ChartSpec("table", title=question.strip()[:80] if question else "Result Preview")
    kind, x, y, title = min(usable, key=lambda r: r[0] != hint)
    return ChartSpec(kind, first[x], first[y], title)


def line_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """CHT-2: (x, y) sorted by x; when there are more than 50 rows, every
    non-null x is distinct, and all of them are dates, y is summed per
    ``yyyy-MM`` month of x. An x that is no date (month names) keeps the raw
    rows. The test is one aggregate; both outcomes are built lazily and one of
    them is kept by a scalar-subquery predicate. The result is written once to
    the shared checkpoint folder (it is read three times)."""
    from martlet.session import cut_lineage
    df = cut_lineage(df)
    text = isinstance(df.schema[x].dataType, T.StringType)
    when = F.coalesce(F.col(x).try_cast("timestamp_ntz"), F.try_to_timestamp(F.col(x), F.lit("yyyy-MM"))
                      .cast("timestamp_ntz")) if text else F.col(x)
    stats = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.count(F.col(x)).alias("known"),
                               F.count(when).alias("dated"), F.count_distinct(F.col(x)).alias("u"))).scalar()
    collapse = ((stats["n"] > fixed.LINE_COLLAPSE_ROWS) & (stats["n"] == stats["u"])
                & (stats["known"] == stats["dated"]))
    monthly = (df.groupBy(F.date_format(when, "yyyy-MM").alias("x"))
               .agg(F.sum(F.col(y)).alias("y"))
               .select(F.col("x").cast("string").alias("x"), round6("y").alias("y")))
    raw = df.select(F.col(x).cast("string").alias("x"), round6(y).alias("y"))
    return monthly.filter(collapse).unionByName(raw.filter(~collapse)).orderBy("x")


def chart_points(df: DataFrame, hint: str | None = None, sample: int | None = None,
                 order: list | None = None) -> DataFrame:
    """CHT-1/CHT-3: (chart_type, x_field, y_field, x, y) rows to draw; a table
    chart gives the result's own rows, marked with their chart type.
    ``sample`` keeps the first rows (in ``order``) that feed the image."""
    spec = infer_chart(df, hint)
    src = df.orderBy(*order) if order else df
    if spec.chart_type == "table":
        shown = chart_sample(src, sample) if sample is not None else src
        return shown.select(F.lit("table").alias("chart_type"), "*")
    if spec.chart_type == "line":
        pts = line_points(df, spec.x_field, spec.y_field)
    else:
        pts = src.select(F.col(spec.x_field).alias("x"), F.col(spec.y_field).cast("double").alias("y"))
    if sample is not None:
        pts = chart_sample(pts, sample)
    return pts.select(F.lit(spec.chart_type).alias("chart_type"), F.lit(spec.x_field).alias("x_field"),
                      F.lit(spec.y_field).alias("y_field"), "x", "y")


def chart_sample(df: DataFrame, n: int = fixed.CHART_SAMPLE_ROWS) -> DataFrame:
    """CHT-3: the first rows that feed the chart image."""
    return df.limit(n)
