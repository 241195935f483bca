"""The stored tables as temporary views, for users who ask in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tenderloom.schemas import NOTICES, PROCEDURE_LINKS
from tenderloom.sources.tables import read_or_empty
from tenderloom.streaming.ingest import links_table, notices_table, tenders_table


def register_dataset(spark: SparkSession, target: str) -> None:
    """Views `notices` and `procedure_links` over a target of `build_dataset`."""
    read_or_empty(spark, f"{target}/notices", NOTICES).createOrReplaceTempView("notices")
    read_or_empty(spark, f"{target}/links", PROCEDURE_LINKS).createOrReplaceTempView("procedure_links")


def register_ingested(spark: SparkSession, root: str) -> None:
    """Views `notices`, `tenders` and `procedure_links` over incrementally ingested tables.

    A view shows the state at the time of registering; register again after a run.
    """
    views = {"notices": notices_table, "tenders": tenders_table, "procedure_links": links_table}
    for name, table in views.items():
        table(root).read(spark).createOrReplaceTempView(name)
