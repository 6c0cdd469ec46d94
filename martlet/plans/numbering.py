"""Consecutive row ids in a global order without a single-task window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Instead the rows are range-partitioned and sorted once, each row gets its
partition and its position in it, and that result is *written* to the shared
folder; counting the partitions and adding their start offsets then read the
written rows only. Nothing depends on the range partitioning being evaluated
twice alike (its bounds come from a sample, and plans differ in how they
coalesce or reuse exchanges). The order columns need not be unique: rows that
tie get consecutive ids in the order they were written in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.plans.joins import broadcast_if_bounded

_LOW_BITS = 1 << 33  # monotonically_increasing_id: position within the partition


def with_ordered_ids(df: DataFrame, order_cols: list, id_col: str = "id",
                     start: int = 1, partitions: int | None = None) -> DataFrame:
    """``df`` with ``id_col``: ``start``, ``start + 1``, ... in the order of
    ``order_cols``. ``partitions`` (default: the session's shuffle partitions)
    is explicit, so adaptive execution does not change it."""
    from martlet.session import scratch_path
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
     .withColumn("_part", F.spark_partition_id())
     .withColumn("_pos", F.monotonically_increasing_id() % F.lit(_LOW_BITS))
     .write.parquet(path))
    stored = spark.read.parquet(path)
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # the running sum sees one row per partition, never the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (stored.join(broadcast_if_bounded(offsets), "_part")
            .withColumn(id_col, (F.col("_offset") + F.col("_pos") + F.lit(start)).cast("bigint"))
            .drop("_part", "_pos", "_offset"))
