"""Joins of a large side with a key that a few values dominate.

A shuffle join deals rows out by key, so a key with a third of all rows is one
task. ``hot_join`` finds such keys with a mergeable frequent-items summary (Spark's
``approx_top_k``: one scan, combined on the map side, at most ``TRACKED`` counters),
joins their rows by a broadcast of just those keys' rows of the other side, and
shuffles the rest, in which no key holds more than about a task's fair share.

Which keys count as hot only decides how rows travel, never the result: both
halves are complete for their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.plans.joins import BROADCAST_BYTE_BOUND, DIMENSION_ROW_BOUND, fits_broadcast

TRACKED = 10_000
MOST_HOT = 1_000


def hot_values(df: DataFrame, key: str, partitions: int | None = None, tracked: int = TRACKED,
               most: int = MOST_HOT) -> list:
    """Values of ``key`` with more than half of a shuffle partition's share of
    the rows, at most ``most`` of them (there can't be more than twice as many
    as partitions); nulls are never joined and don't count."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(most, 2 * parts)
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{key}`, {k}, {max(tracked, 2 * k)})").alias("top")).first()
    least = max(2.0, found["rows"] / (2.0 * parts))
    return [x["item"] for x in (found["top"] or []) if x["item"] is not None and x["count"] >= least]


def hot_join(large: DataFrame, other: DataFrame, large_key: str, other_key: str, how: str = "inner",
             max_rows: int = DIMENSION_ROW_BOUND, max_bytes: int = BROADCAST_BYTE_BOUND, partitions: int | None = None) -> DataFrame:
    """``large`` joined with ``other`` on ``large_key = other_key`` (inner, left or
    left_semi). ``other`` is broadcast whole if it is proven small; else the
    rows of hot keys are joined by a checked broadcast and the rest by shuffle."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join {how}")
    on = F.col(large_key) == F.col(other_key)
    if fits_broadcast(other, max_rows, max_bytes):
        return large.join(F.broadcast(other), on, how)
    hot = hot_values(large, large_key, partitions)
    if not hot:
        return large.join(other, on, how)
    # null keys stay with the rest, where an outer join keeps them
    is_hot = F.coalesce(F.col(large_key).isin(hot), F.lit(False))
    few = other.where(F.col(other_key).isin(hot))
    if not fits_broadcast(few, max_rows, max_bytes):  # a hot key with very many partners
        return large.join(other, on, how)
    rest = large.where(~is_hot).join(other.where(~F.col(other_key).isin(hot)), on, how)
    return large.where(is_hot).join(F.broadcast(few), on, how).unionByName(rest)
