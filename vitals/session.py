"""Session helpers.

Everything in the library takes a ``SparkSession`` from the caller; these
helpers only build one for local runs/tests and resolve the shared scratch
folder (``spark.checkpoint.dir``) used to cut lineage or stage files.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "vitals",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (cluster jobs bring their own)."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 executor_memory_gb: float = 16.0, target_partition_mb: int = 128,
                 shuffle_fraction: float = 0.1) -> dict[str, str]:
    """Sizing for a cluster run over ``input_bytes`` of Parquet.

    Shuffled data is a fraction of the input (column pruning, partial
    aggregation), so shuffle partitions target ``target_partition_mb`` of the
    estimated shuffle volume, at least 3 waves of tasks. Scan splits are
    capped so a task's input fits its share of executor memory; AQE splits
    skewed partitions at runtime.
    """
    slots = max(1, executors * cores_per_executor)
    per_task_mb = executor_memory_gb * 1024 * 0.6 / max(1, cores_per_executor)
    split_mb = int(max(32, min(512, per_task_mb / 4)))
    est = input_bytes * shuffle_fraction / (target_partition_mb * 1024 * 1024)
    shuffle = int(max(3 * slots, est))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared scratch folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system path);
    without it the call fails, as executors would write to their own disks.
    Only a local master gets a fresh private folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("VITALS_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is None:
        return d
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def session_key(spark: SparkSession) -> str:
    """Identifies the running application (for per-session stored tables)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared scratch folder for staged tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vitals-{name}-{uuid.uuid4().hex[:12]}"
