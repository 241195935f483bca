"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Row- and plan-level defaults that the jobs are written for. Partition counts are left to
# the cluster: adaptive execution coalesces small shuffles and splits skewed ones.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even if what follows then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "tenderloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the defaults above; `settings` override them (dots written as `__`)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    chosen = SESSION_SETTINGS | {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(frame: DataFrame) -> DataFrame:
    """The same rows, dealt out evenly over as many tasks as a shuffle has, for work that is dear by the row.

    Files are divided by bytes and row groups, so that millions of narrow rows may come in one task. The number of
    partitions is given, since adaptive execution would put small ones together again.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, or else below the warehouse; all executors share both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tenderloom/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The same rows read from files in a fresh shared folder, for what is needed in several places."""
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
