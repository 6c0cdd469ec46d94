"""Sinks: table writes, CSV export, the export summary, the session log and
the metrics log. Writes go to a shared location (never a machine-local
temporary folder); each call writes whole partitions, so a retried task
rewrites only its own files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.plans.joins import broadcast_if_bounded

SESSION_SCHEMA = ("session_id string, created_at timestamp, question string, approved_sql string, "
                  "row_count int, chart_type string, csv_path string, xlsx_path string, "
                  "pdf_path string, warnings string")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: ``overwrite`` replaces (uploads), ``append`` adds (seeding)."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unsupported mode {mode}")
    df.write.mode(mode).parquet(path)


#: The column, and folder level, that tells the batches of an append apart.
BATCH = "batch_id"


def append_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """SNK-1 / SNK-4, idempotent append: the batch lands once however often it is
    tried. Its rows are a partition of their own, which a retry replaces as a
    whole (dynamic partition overwrite) without touching other batches."""
    (df.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH).parquet(path))


def append_new_batches(df: DataFrame, path: str, batch_col: str) -> None:
    """Append the rows of those batches of ``df`` that ``path`` doesn't hold yet:
    an anti-join with the written batch ids, which are folder names."""
    spark = df.sparkSession
    rows = df.withColumnRenamed(batch_col, BATCH).withColumn(BATCH, F.col(BATCH).cast("string"))
    if _exists(spark, path):
        known = spark.read.schema(f"{BATCH} string").parquet(path).select(F.col(BATCH).alias("_known")).distinct()
        rows = rows.join(broadcast_if_bounded(known), F.col(BATCH) == F.col("_known"), "left_anti")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows, without the batch ids."""
    return spark.read.parquet(path).drop(BATCH)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace_table(df: DataFrame, path: str) -> None:
    """SNK-1, replace: the new rows are written beside the table and take its
    place when they are complete, so ``df`` may read the table it replaces, and a
    failed write leaves the old rows."""
    spark = df.sparkSession
    staged, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(staged.toString())
    now = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(now)
    if had and not fs.rename(now, old) or not fs.rename(staged, now):
        raise OSError(f"could not move the new rows to {path}")
    if had:
        fs.delete(old, True)


def export_csv(df: DataFrame, path: str) -> None:
    """SNK-2: result rows with a header line, no index column; fields are quoted
    as SRC-1 reads them (RFC 4180)."""
    from martlet.sources.files import QUOTED
    df.write.mode("overwrite").options(**QUOTED).option("header", True).csv(path)


def export_summary(insights: DataFrame, sql_text: str) -> DataFrame:
    """SNK-3: 4 rows (section, content): the SQL, then insight_1..3 (the
    first three insights by position), missing ones as empty text."""
    spark = insights.sparkSession
    # an insight list holds at most one row per insight kind (4), so the
    # ordered list below is bounded by construction
    ordered = insights.agg(F.sort_array(F.collect_list(F.struct("position", "message"))).alias("_l"))
    filled = (ordered.select(F.posexplode(F.array(*[F.element_at(F.col("_l"), k)["message"]
                                                   for k in (1, 2, 3)])).alias("_k", "message"))
              .select(F.concat(F.lit("insight_"), (F.col("_k") + 1).cast("string")).alias("section"),
                      F.coalesce(F.col("message"), F.lit("")).alias("content")))
    head = spark.range(1).select(F.lit("sql").alias("section"), F.lit(sql_text).alias("content"))
    return head.unionByName(filled)


def json_list_text(items) -> Column:
    """A list of strings as JSON text laid out like Python's ``json.dumps``
    (``["a", "b"]``: comma and space between items; each item escaped by
    ``to_json``, identical for ASCII text)."""
    quoted = F.transform(items, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def session_rows(batch: DataFrame) -> DataFrame:
    """SNK-4: normalise a batch of session rows: generated id when none,
    creation time, warnings list as JSON text."""
    w = F.col("warnings")
    return batch.select(
        F.coalesce(F.col("session_id"), F.expr("uuid()")).alias("session_id"),
        F.coalesce(F.col("created_at").cast("timestamp"), F.current_timestamp()).alias("created_at"),
        "question", "approved_sql", F.col("row_count").cast("int").alias("row_count"), "chart_type",
        "csv_path", "xlsx_path", "pdf_path",
        json_list_text(F.coalesce(w, F.array().cast("array<string>"))).alias("warnings"))


def append_sessions(batch: DataFrame, path: str, batch_id: str | None = None) -> None:
    """SNK-4; with ``batch_id`` a retried batch lands once (``append_batch``)."""
    if batch_id is None:
        write_table(session_rows(batch), path, "append")
    else:
        append_batch(session_rows(batch), path, batch_id)


def recent_sessions(log: DataFrame, limit: int = 10) -> DataFrame:
    """SRC-4: newest rows first, without SQL text and warnings (a top-k:
    each partition keeps its ``limit`` newest rows before the merge)."""
    return (log.select("session_id", "created_at", "question", "row_count", "chart_type",
                       "csv_path", "xlsx_path", "pdf_path")
            .orderBy(F.col("created_at").desc(), F.col("session_id")).limit(limit))


def log_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-5: append long-form metric rows (run, step, metric, value)."""
    write_table(metrics.select("run", F.col("step").cast("bigint"), "metric",
                               F.col("value").cast("double")), path, "append")


def metrics_wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The wide form of the metrics log: one column per listed metric."""
    return (metrics.groupBy("run", "step").pivot("metric", names)
            .agg(F.first("value", ignorenulls=True)))


def session_stats(log: DataFrame) -> DataFrame:
    """TXT-11: per chart type: sessions, average rows, share with warnings."""
    has_warn = (F.size(F.from_json(F.col("warnings"), "array<string>")) > 0).cast("int")
    return (log.groupBy("chart_type")
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum(F.col("row_count").cast("bigint")).alias("total_rows"),
                 F.sum(has_warn).cast("bigint").alias("with_warnings"))
            .withColumn("warning_rate", F.round(F.col("with_warnings") / F.col("sessions") * 1e6) / 1e6))
