"""PRF-7 / PRF-8 for integer keys by bitmaps: uniqueness and containment
without shuffling the rows.

Keys are dealt to buckets of 32,768 consecutive values; a bucket's keys are one
bitmap of 4 KB, built on the map side and merged. A key column is unique exactly
if its bitmaps have as many bits as it has values, and contained in another
exactly if or-ing the two changes no count. Only buckets in which that fails are
looked at by value, so a clean table costs one small row per bucket and task.

Bitmaps pay where keys are dense: ``dense`` asks for at least one key per
``SPREAD`` values of the range, from one aggregate. Other keys take the shuffle
form of ``profile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.plans.joins import broadcast_if_bounded

SPREAD = 64
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def dense(df: DataFrame, key: str, spread: int = SPREAD) -> bool:
    """Whether ``key`` is an integer column with a value in every ``spread``
    of its range on average."""
    if not isinstance(df.schema[key].dataType, _INTEGRAL):
        return False
    r = df.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return r["n"] > 0 and r["hi"] - r["lo"] < r["n"] * spread


def bucket(key: str) -> Column:
    return F.bitmap_bucket_number(F.col(key).cast("bigint"))


def bitmaps(df: DataFrame, key: str) -> DataFrame:
    """``bucket, n, bits``: values and bitmap of each bucket of ``key``."""
    rows = df.where(F.col(key).isNotNull()).select(bucket(key).alias("bucket"),
                                                   F.bitmap_bit_position(F.col(key).cast("bigint")).alias("at"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg("at").alias("bits"))


def _written(df: DataFrame, label: str) -> DataFrame:
    from martlet.session import scratch_path
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _within(df: DataFrame, key: str, buckets: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key lies in one of ``buckets(bucket)``."""
    few = broadcast_if_bounded(buckets.select(F.col("bucket").alias("__bucket")))
    return df.join(few, bucket(key) == F.col("__bucket"), "left_semi")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """PRF-7: values of an integer ``key`` that occur more than once (null among
    them), with their counts."""
    full = _written(bitmaps(df, key).where(F.bitmap_count("bits") < F.col("n")).select("bucket"), "repeated-buckets")
    nulls = df.where(F.col(key).isNull()).select(key)
    some = nulls if full.first() is None else nulls.unionByName(_within(df.where(F.col(key).isNotNull()), key, full).select(key))
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """PRF-8: child rows whose integer key has no parent; null keys refer to nothing."""
    mine = bitmaps(child, fk).select("bucket", "bits", F.lit(None).cast("binary").alias("theirs"))
    other = bitmaps(parent, pk).select("bucket", "bits", F.col("bits").alias("theirs"))
    # per bucket the bits of both sides, and of the parent alone
    both = mine.unionByName(other).groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("all"),
                                                         F.bitmap_count(F.bitmap_or_agg("theirs")).alias("known"))
    open_ = _written(both.where(F.col("all") > F.coalesce("known", F.lit(0))).select("bucket"), "orphan-buckets")
    present = child.where(F.col(fk).isNotNull())
    if open_.first() is None:
        return present.limit(0)
    keys = _within(parent, pk, open_).select(F.col(pk).alias("__pk"))
    return _within(present, fk, open_).join(keys, F.col(fk) == F.col("__pk"), "left_anti")
