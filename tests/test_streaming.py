from pyspark.sql import functions as F

from paths import SF_SMALL
from martlet.session import Warehouse
from martlet.streaming import start_session_log_stream
from martlet.suite.quality import _session_batch


def test_session_log_stream_appends_once(spark, tmp_path):
    batch = _session_batch(Warehouse(spark, SF_SMALL))
    src, log, ckpt = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ckpt")
    batch.write.parquet(src)
    q = start_session_log_stream(spark, src, log, ckpt)
    q.awaitTermination()
    n = batch.count()
    assert spark.read.parquet(log).count() == n
    # a second run over the same files adds nothing (exactly-once via checkpoint)
    q2 = start_session_log_stream(spark, src, log, ckpt)
    q2.awaitTermination()
    out = spark.read.parquet(log)
    assert out.count() == n
    assert out.filter(F.col("warnings").startswith("[")).count() == n
