"""Session construction and lineage-cutting storage.

On a cluster the session is built by the platform; ``build_session`` is for
local runs (tests, bench). ``ensure_checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only invents a local one when the
master is ``local[...]`` and nothing is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "crmlake", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run sized from the input volume.

    Shuffle partitions start at about one partition per ``target_partition_bytes``
    of input (at least two per core) and AQE coalesces them at run time; file
    splits match the same size; a skewed partition is split when it is 5x the
    median and above the target; the automatic broadcast threshold stays small
    because the library leaves broadcasts to Spark's size estimates and AQE.
    Example: 100 TB on 1000 executors x 8 cores -> ~400 000 shuffle partitions.
    """
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it when needed.

    Order: an already-set SparkContext checkpoint dir, then the session's
    ``spark.checkpoint.dir``. Only a local master may fall back to a fresh
    folder under the system temp dir; a cluster without a shared folder is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder "
            "(HDFS/S3/ABFS) before running operators that cut lineage")
    folder = tempfile.mkdtemp(prefix="crmlake-ckpt-")
    sc.setCheckpointDir(os.path.join(folder, "ckpt"))
    return sc.getCheckpointDir()
