"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Runtime settings that change results (time zone) or plan quality (AQE).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "hourmark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own; a local one on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if current is None:
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context.

    The driver may have found it on a path of its own, so it goes along as an
    archive of compiled modules through Spark's own file distribution.
    """
    context = spark.sparkContext
    if getattr(context, "_hourmark_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="hourmark-"), "hourmark.zip")
    with zipfile.PyZipFile(archive, "w") as out:
        out.writepy(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(archive)
    context._hourmark_shipped = True
