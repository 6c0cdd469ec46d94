"""Column sketches: one row per column with its counts and a theta sketch of
its distinct values, merged on the map side. Nothing is shuffled by value.

A theta sketch of ``2 ** LG_ENTRIES`` nominal entries holds the hashes below a
threshold: all of them up to that many distinct values (its estimate is then
the exact number), a uniform sample beyond (standard error 1.6 %). Two
sketches therefore share a threshold below which set differences are exact,
which ``inclusion`` uses, and merge without loss, which ``sources.profile_store``
uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions.exprs import nan_to_null

LG_ENTRIES = 12
EXACT_UP_TO = 1 << LG_ENTRIES
#: Four standard errors of an estimate.
FOUR_ERRORS = 4 / (1 << LG_ENTRIES) ** 0.5

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def value_class(dtype: T.DataType) -> str:
    """Columns of one class hold comparable values."""
    if isinstance(dtype, _INTEGRAL):
        return "integer"
    if isinstance(dtype, _FLOATING):
        return "floating"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "instant" if isinstance(dtype, T.TimestampType) else "time"
    return "nested" if isinstance(dtype, _COMPLEX) else "text"


def plain_value(f: T.StructField) -> Column:
    """The column's values as bigint, double or text; equal exactly if they are
    equal within the column's class. NaN counts as missing."""
    c, kind = F.col(f"`{f.name}`"), value_class(f.dataType)
    if kind == "integer":
        return c.cast("bigint")
    if kind == "floating":
        return nan_to_null(c.cast("double"))
    if kind == "instant":
        return F.unix_micros(c)
    if kind == "time":
        return c.cast("timestamp_ntz").cast("string")
    if kind == "nested":
        return F.to_json(F.struct(c.alias("v")))
    if kind == "decimal":  # the same number has the same text whatever its scale
        return F.regexp_replace(c.cast("string"), r"^(-?[0-9]+)(?:\.0*|(\.[0-9]*[1-9])0*)$", "$1$2")
    return c.cast("string")


def column_sketches(df: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``ci, name, class, rows, non_null, sketch``: one row per column, from
    one scan with partial aggregation."""
    fields = df.schema.fields
    vals = df.select(*[plain_value(f).alias(f"v{i}") for i, f in enumerate(fields)])
    agg = vals.agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(fields))],
                   *[F.theta_sketch_agg(f"v{i}", lg_entries).alias(f"s{i}") for i in range(len(fields))])
    items = [F.struct(F.lit(i).alias("ci"), F.lit(f.name).alias("name"), F.lit(value_class(f.dataType)).alias("class"),
                      F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"s{i}").alias("sketch"))
             for i, f in enumerate(fields)]
    return agg.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def warehouse_sketches(tables: dict[str, DataFrame], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``column_sketches`` of all tables in one job, with ``ti`` and
    ``table_name``, written to the shared folder (one row per column)."""
    from martlet.session import scratch_path
    out = None
    for ti, (t, df) in enumerate(tables.items()):
        one = column_sketches(df, lg_entries).select(F.lit(ti).alias("ti"), F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    spark = next(iter(tables.values())).sparkSession
    path = scratch_path(spark, "sketches")
    out.write.parquet(path)
    return spark.read.parquet(path)


def estimate(sketch: str) -> Column:
    return F.theta_sketch_estimate(sketch)


def may_be_key(estimated: Column) -> Column:
    """Whether a column without nulls may hold a different value in every row:
    exact where the sketch is."""
    rows, n = F.col("rows"), F.col("non_null")
    exact = rows <= EXACT_UP_TO
    return (rows > 0) & (n == rows) & F.when(exact, estimated == rows).otherwise(estimated >= (1 - FOUR_ERRORS) * rows)
