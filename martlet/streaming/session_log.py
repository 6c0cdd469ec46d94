"""The session log as a stream (SNK-4 / TXT-11 over Structured Streaming).

Session rows arrive as files (one batch of questions per file). The stream
normalises them with the same expression as the batch sink and appends them
to the parquet log through the file sink, whose checkpoint makes the append
exactly-once: a restarted query (or a lost executor) never duplicates or
drops a batch. No state is kept, so the stream scales with the input rate.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from martlet.session import scratch_path
from martlet.sources.sinks import session_rows

BATCH_SCHEMA = ("session_id string, created_at timestamp, question string, approved_sql string, "
                "row_count int, chart_type string, csv_path string, xlsx_path string, pdf_path string, "
                "warnings array<string>")


def start_session_log_stream(spark: SparkSession, source_dir: str, log_path: str,
                             checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append every session batch found in ``source_dir`` to ``log_path``.
    ``available_now`` processes what is there and stops (batch-like runs);
    otherwise the query keeps running and picks up new files."""
    src = spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", 64).parquet(source_dir)
    writer = (session_rows(src).writeStream.format("parquet").outputMode("append")
              .option("path", log_path)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "session-log-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
