"""Session defaults and shared-folder helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Defaults for a session this package creates itself (tests, bench).  A
# session handed in by a cluster keeps its own settings.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches stay small so a Python fold never holds a hot key whole.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    # Keyed stream state lives in RocksDB, on disk; its list states and timers are what the stream forms use.
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def get_session(master: str | None = None, app: str = "reelspark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset on a local master (tests) do we pick one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if fallback is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = fallback or os.path.join("/tmp", "reelspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh sub-folder of the shared checkpoint folder, removed when the application ends unless ``keep``."""
    base = ensure_checkpoint_dir(spark)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, derived from the input size.

    * shuffle partitions: enough that a partition holds about
      ``target_partition_bytes`` of the *input* (shuffles rarely grow it),
      at least two waves of tasks; AQE then coalesces small ones and splits
      skewed ones, so this is an upper bound, not a guess to get exactly right;
    * scans: the same split size, so a scan task reads one target-sized slice;
    * broadcast: only what AQE measures under 64 MiB at run time;
    * streaming state: RocksDB, so per-key state lives on disk, not the heap.
    """
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }


def reliable_checkpoint(df):
    """Cut lineage by writing ``df`` to the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
