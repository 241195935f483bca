"""Landed specification documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first bytes of every PDF file. Fixed value.
_PDF_MARK = b"%PDF-"


def is_pdf(content: Column) -> Column:
    """Judged by the leading bytes; names and declared types are not trusted."""
    return F.coalesce(F.startswith(content, F.lit(bytearray(_PDF_MARK))), F.lit(False))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path` with their size and whether they are PDF.

    Spark lists no empty files. Scoring joins from the tenders, so a tender whose document is
    missing here counts as never read instead of dropping out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", is_pdf(F.col("content")).alias("is_pdf"))
