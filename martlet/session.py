"""Session helpers: building a session, loading the warehouse tables, and
cutting lineage into the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


PARTITION_BYTES = 256 << 20
BROADCAST_BYTES = 64 << 20


def scale_conf(input_bytes: int, total_cores: int,
               partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Settings sized for the data so that no task holds more than about
    ``partition_bytes``: scan splits of that size; enough shuffle partitions
    for the largest shuffle (taken as the input size) at that size, at least
    two waves of the cluster's cores and a whole number of waves; AQE then
    coalesces small partitions to the advisory size and splits a partition
    more than 5x the median (a hot key) in sort-merge joins. The broadcast
    threshold is explicit (forced broadcasts are size-checked separately,
    ``plans.joins``)."""
    waves = max(2, -(-input_bytes // (partition_bytes * total_cores)))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(waves * total_cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int | None = 8,
                  app_name: str = "martlet", input_bytes: int | None = None,
                  total_cores: int | None = None, extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session used by tests and the bench. With ``input_bytes`` (and the
    cluster's ``total_cores``) the partition settings come from
    ``scale_conf``; on a cluster, callers may also pass their own builder:
    everything else in the package only needs a session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    if input_bytes is not None:
        for k, v in scale_conf(input_bytes, total_cores or 8).items():
            builder = builder.config(k, v)
    elif shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only when none is configured (tests, a laptop
    in local mode) a private folder is created; on a cluster an unset
    value is an error because a machine-local folder would not survive the
    loss of an executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="martlet-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_runs: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "martlet-scratch", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediate tables and file round trips, below
    this application's folder in the shared checkpoint location (or that of the
    innermost ``scratch_run``)."""
    return os.path.join(_runs[-1] if _runs else _own_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside go to a folder of their own, which is
    removed at the end: for work whose results are written elsewhere by then.
    Results that are still to be computed lazily must not leave it."""
    folder = os.path.join(_own_folder(spark), f"run-{uuid.uuid4().hex}")
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        _remove(spark, folder)


def remove_scratch(spark: SparkSession) -> None:
    """Remove everything that this application wrote as intermediate tables."""
    _remove(spark, _own_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): the data is written to the
    shared checkpoint folder, so a lost executor does not force a recompute
    of the whole upstream plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Warehouse:
    """Lazy accessor for the driver's parquet tables: ``wh.lineitem`` is a
    fresh scan, so Catalyst prunes columns and pushes filters per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def register_views(self) -> None:
        for name in TABLES:
            read_table(self.spark, self.sf_dir, name).createOrReplaceTempView(name)
