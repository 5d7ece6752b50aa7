"""Session set-up and lineage helpers.

The library never sets cluster-wide options behind the user's back: ``get_spark``
is a convenience for tests, benches and scripts.  On a cluster the session is
built by the job launcher and only read here.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Options that matter for the library's plans.  AQE re-plans joins at runtime
# (broadcast when the measured side is small, split skewed partitions), so the
# code only hints broadcast for tables with a checked size bound.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go when their frame does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lexiforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("LEXIFORGE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local
    master without that setting (tests) gets a fresh scratch folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = tempfile.mkdtemp(prefix="lexiforge-ckpt-")
    sc.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder name below the shared folder, as a path of a mounted file system.

    Raises ValueError when the folder is in a store that cannot be memory-mapped."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[len("file:"):].lstrip("/")
    if "://" in base or not base.startswith("/"):
        raise ValueError(f"{prefix}: spark.checkpoint.dir must be a mounted folder for memory-mapped files, not {base}")
    return f"{base}/{prefix}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the loss
    of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hash-partitions a narrow input on ``keys``, into the session's number of shuffle partitions or ``partitions``; a
    partition count of 0 leaves the scan's own partitions."""
    if partitions == 0:
        return df
    return df.repartition(*([partitions] if partitions else []), *keys)
