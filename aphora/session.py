"""Session settings the jobs in this package are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE does the run-time work the operators rely on: it coalesces small shuffle partitions, turns joins
# with a small measured side into broadcasts, and splits skewed partitions of sort-merge joins.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Generated methods above 8000 bytes are not compiled by the JVM. Wide expressions (validation, log parsing) run
    # faster when Spark then generates them in smaller pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    app_name: str = "aphora", master: str | None = None, shuffle_partitions: int | None = None, **extra: str
) -> SparkSession:
    """A session with the settings above; ``master`` and sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests and trials on one machine); the session then gets one temporary
    folder for all its tables, and keeps it as that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="aphora-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
