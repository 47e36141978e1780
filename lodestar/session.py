"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC timestamps (the oracle compares
# naive timestamps), AQE for runtime re-planning and skew splitting, and
# no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Fused stages of the candidate search generate methods above the
    # JVM's 8 KB JIT limit; above this size Spark falls back to split,
    # JIT-compilable code instead of running them in the bytecode
    # interpreter (about 4x faster here).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # room for the generated classes of many queries in one JVM
    "spark.driver.extraJavaOptions": "-XX:ReservedCodeCacheSize=512m",
}

TUNING = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the heavy operators rely on, only
    where the session still has Spark's default value."""
    for key, (default, value) in TUNING.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lodestar", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir``. Only a session on a local master
    gets a fresh scratch folder where it has none: elsewhere a folder of
    one machine would not be seen by the others, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lodestar-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
