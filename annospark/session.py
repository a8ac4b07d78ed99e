"""Session construction and cluster-aware settings.

On a cluster the session already exists (spark-submit / notebooks); the
helpers here only fill in settings that are unset, so a cluster's own
``spark.checkpoint.dir`` and shuffle sizing always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session; applied only when the key is unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 64 MB splits keep the long text columns of `documents` spill-friendly.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "annospark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("ANNOSPARK_DRIVER_MEM", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, as `spark.checkpoint.dir` names it.

    Where it is unset, a local master (tests, bench) gets a scratch folder; any
    other master is refused, as its executors could not see one.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception as e:  # noqa: BLE001 - Spark Connect has no context; the server's setting applies
        if not conf:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share") from e
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="annospark-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
