"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.session import scratch_path

#: Fixed value: a word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()

#: Rows that go to a Python worker at once; texts can be long.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: once per
    application its source files go to the executors through Spark. Where the
    session has Spark's default number of rows per Arrow batch, a smaller one
    is set, which bounds the workers' memory on long texts."""
    name, default, smaller = ARROW_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, smaller)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="martlet-src-"), "martlet_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release() -> None:
    """Hand freed memory back to the system, as far as the allocators can.
    Python workers live on through a job's stages, and what their allocators
    keep of each would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that gives memory back when its task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return task


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder named by
    ``spark.checkpoint.dir`` and read it back: the plan behind it is not run
    again, and a lost executor costs no more than a reread."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeatable(docs: DataFrame) -> DataFrame:
    """``docs`` itself when every evaluation deals its rows out alike (a plan
    without a shuffle below it); otherwise a written copy. Operators that read
    their input twice and must see the same partitions use this."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialise(docs, "input") if re.search(r"(?<!Broadcast)Exchange", plan) else docs


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (one scan of one column)."""
    n = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0]
    return int(n or 0)


def shard_count(total_bytes: int, bytes_per_shard: int, least: int = 12) -> int:
    """Shards so that none holds much more than ``bytes_per_shard``; the
    number follows the input and has no upper bound."""
    return max(least, -(-total_bytes // bytes_per_shard))
