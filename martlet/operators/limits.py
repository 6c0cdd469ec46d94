"""Row limits on results: wrapped limit, export cap with an overflow flag,
and previews. A limit after an ``orderBy`` plans as
``TakeOrderedAndProject`` (per-partition top-k, then a k-row merge)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions import fixed


def limited(df: DataFrame, n: int) -> DataFrame:
    """LIM-1: ``SELECT * FROM (q) LIMIT n``."""
    return df.limit(n)


def capped(df: DataFrame, cap: int = fixed.EXPORT_CAP) -> DataFrame:
    """LIM-2: at most ``cap`` rows plus an ``overflow`` column that is true
    when the input had more. The query runs once: its first ``cap + 1`` rows
    are written to the shared folder with their positions (a limit leaves one
    partition, so positions are consecutive), flagged and cut there."""
    from martlet.session import scratch_path
    path = scratch_path(df.sparkSession, "capped")
    df.limit(cap + 1).withColumn("_pos", F.monotonically_increasing_id()).write.parquet(path)
    top = df.sparkSession.read.parquet(path)
    over = top.agg(F.count(F.lit(1))).first()[0] > cap
    return top.where(F.col("_pos") < cap).drop("_pos").withColumn("overflow", F.lit(over))


def preview_rows(df: DataFrame, n: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """LIM-3: the first rows of a result."""
    return df.limit(n)
