"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every kbspark job relies on: UTC session time (as_of literals are UTC), adaptive
# execution with skew-join splitting (hot companies / documents), no UI server.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kbspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A local session without one (tests) gets a scratch folder of its own. On a cluster that would
    be a folder that the executors cannot see, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="kbspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where a small, bounded intermediate (top-k retrieval results, parsed replies) feeds
    several branches of a plan: the branches then read the written rows instead of each
    re-running the lineage, and a lost executor re-reads files instead of recomputing.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits and shuffle partitions target ``partition_bytes`` each (so a task's working
    set fits comfortably in executor memory and spills stay rare); the shuffle partition count
    is at least two waves of the cluster's cores, and AQE coalesces small partitions and splits
    skewed ones around the same advisory size. Pass the result as ``extra`` to ``get_session``.
    """
    waves = 2 * executors * cores_per_executor
    shuffle = max(waves, -(-input_bytes // partition_bytes))
    size = f"{partition_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * partition_bytes // (1024 * 1024)}m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }
