"""Session helpers: one place that decides Spark settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on.  AQE coalesces small shuffles and splits
# skewed join partitions at run time; the UI is off (no web server).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Joins on (record_id, x, ...) between sides already hash-partitioned on
    # record_id (same partition count) reuse that partitioning instead of
    # shuffling both sides again on the full key.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "scorecraft", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that ``spark.checkpoint.dir`` names; only where that
    is unset and all runs on one machine (tests) it is a scratch folder there."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scorecraft-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
