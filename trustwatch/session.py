"""Session defaults. A cluster brings its own session; this is for tests, the bench and notebooks."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import SparkSession


def build_session(app: str = "trustwatch", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; a private temporary folder is used only where
    that setting is missing (tests on one machine).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="spark-trustwatch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


EVERY = 10.0
_released = [time.monotonic()]


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, at most every ``EVERY`` seconds. Spark removes the shuffle files of finished steps only when their plans are collected, which a
    driver with much memory does once in half an hour; until then they take disk."""
    if time.monotonic() - _released[0] >= EVERY:
        gc.collect()
        spark._jvm.System.gc()  # plans that Python has just let go of are found by the next one
        _released[0] = time.monotonic()
