"""SRC-1, quoted newlines in files that stay splittable.

Spark's multi-line CSV reader takes a file as one task. Here the lines of every
split are read on their own, and whether a newline ends a record follows from
the parity of the quotes before it in the file:

1. One scan counts, per split, its quotes (and lines that aren't UTF-8, for
   the encoding): one small row per split.
2. Prefix sums over a file's splits give the parity each split begins with, and
   the split in which a record that goes on over its beginning has started.
3. Each split's lines are numbered into records by a window over the split (at
   most ``spark.sql.files.maxPartitionBytes`` of text); pieces of a record that
   crosses splits are few and are stitched in a group of their own.
4. Each record is parsed by Spark's CSV expression.

The text is shuffled once, by split. Quotes follow RFC 4180: a quote inside a
field is doubled, which keeps the parity. A record ends at ``\\n``; a ``\\r``
before it goes with it. A quote that is never closed makes the rest of its file
one record, as it does for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlet.plans.joins import broadcast_if_bounded


def decoded(line: Column, encoding: str) -> Column:
    """A line of the text source, which hands bytes through as they are."""
    return line if encoding == "UTF-8" else F.decode(line.cast("binary"), encoding)


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``value, file, block, at, quotes``: every line with its split (a file's
    ``block`` starts there) and its place in the split."""
    text = spark.read.option("lineSep", "\n").text(path)
    v = decoded(F.col("value"), encoding)
    quotes = F.length(v) - F.length(F.replace(v, F.lit('"'), F.lit("")))
    return text.select(v.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), quotes.alias("quotes"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n_lines, quotes, odd_lines, not_utf8, first_odd, last``
    per split, written to the shared folder: the only scan that detection needs."""
    from martlet.session import scratch_path
    odd = F.col("quotes") % 2 == 1
    found = lines(spark, path).groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quotes").alias("quotes"), F.count_if(odd).alias("odd_lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("not_utf8"), F.min(F.when(odd, F.col("at"))).alias("first_odd"),
        F.max("at").alias("last"))
    out = scratch_path(spark, "splits")
    found.write.parquet(out)
    return spark.read.parquet(out)


def _placed(found: DataFrame) -> DataFrame:
    """``file, block, inside, owner, feeds``: whether a split begins inside a
    quoted field, then the split that its first record began in; whether its own
    last record goes on in the next."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    known = found.withColumn("inside", inside)
    starts = ~F.col("inside") | (F.col("first_odd") < F.col("last"))
    owner = F.last(F.when(starts, F.col("block")), ignorenulls=True).over(before)
    known = known.withColumn("owner", F.when(F.col("inside"), owner))
    feeds = F.coalesce(F.lead("inside").over(order), F.lit(False)) & starts
    return known.select("file", "block", "inside", "owner", feeds.alias("feeds"))


def records(spark: SparkSession, path: str, encoding: str, found: DataFrame) -> DataFrame:
    """``record, is_first``: all records of the files but blank ones, and whether
    a record is the first of its file."""
    placed = broadcast_if_bounded(_placed(found))
    split = Window.partitionBy("file", "block")
    upto = split.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = split.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(spark, path, encoding).join(placed, ["file", "block"])
    begins = (F.coalesce(F.sum("quotes").over(upto), F.lit(0)) + F.col("inside").cast("int")) % 2 == 0
    rows = rows.withColumn("begins", begins.cast("int"))
    rows = rows.withColumn("nth", F.sum("begins").over(here)).withColumn("nths", F.sum("begins").over(split))
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    pieces = rows.groupBy("file", "block", "nth", "nths", "owner", "feeds").agg(
        F.array_join(F.transform(listed, lambda x: x["value"]), "\n").alias("piece"))
    crosses = (F.col("nth") == 0) | (F.col("feeds") & (F.col("nth") == F.col("nths")))
    alone = pieces.where(~crosses).select(F.col("piece").alias("record"), ((F.col("block") == 0) & (F.col("nth") == 1)).alias("is_first"))
    begun = F.when(F.col("nth") == 0, F.col("owner")).otherwise(F.col("block"))
    first = F.col("block").eqNullSafe(F.lit(0)) & (F.col("nth") == 1)
    stitched = pieces.where(crosses).groupBy("file", begun.alias("begun")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "\n").alias("record"),
        F.max(first).alias("is_first"))
    every = alone.unionByName(stitched.select("record", "is_first"))
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def read_records(spark: SparkSession, path: str, encoding: str, found: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    """The fields of all records but each file's first, the header."""
    every = records(spark, path, encoding, found).where("NOT is_first")
    parsed = F.from_csv("record", F.lit(schema), {**options, "multiLine": "true", "mode": "PERMISSIVE"})
    return every.select(parsed.alias("r")).select("r.*")
