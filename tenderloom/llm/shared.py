"""The folder that all executors share, for written intermediates and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 200_000  # short rows, some megabytes of them


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, or else below the warehouse; all executors share both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """The same rows read from files: lineage ends there, and a lost executor costs no second computation.

    A file costs more than the few rows that each of many shuffle partitions may hold. With `rows`, a bound on the rows
    that the last stage reads, its partitions are put together: to one a core, or more if a task had over TASK_ROWS."""
    if rows is not None:
        frame = frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)
