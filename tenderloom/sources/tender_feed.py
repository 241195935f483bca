"""Landed pages of the tender syndication feed (XML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.schemas import FEED_ENTRY

# Matched by local name, since namespace addresses change between versions of the format.
# Other elements beside the entries, such as deletion marks, are not read.
_OPTIONS = {"rowTag": "entry", "ignoreNamespace": "true", "mode": "FAILFAST"}


def _with_arrival(entries: DataFrame) -> DataFrame:
    return entries.select(
        *FEED_ENTRY.names,
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("file"),
    )


def number_entries(entries: DataFrame) -> DataFrame:
    """Entries with `landed`, which orders them by arrival: file by file, then by position."""
    landed = F.struct("landed_at", "file", F.monotonically_increasing_id().alias("position"))
    return entries.select(*FEED_ENTRY.names, landed.alias("landed"))


def scan_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all feed pages below `path`, with `landed`, which orders them by arrival.

    One task reads one page; pages are bounded by the publisher, at some 15 MB.
    """
    reader = spark.read.format("xml").options(**_OPTIONS).schema(FEED_ENTRY)
    return number_entries(_with_arrival(reader.load(path)))


def stream_entries(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Entries as their pages arrive, a bounded number of pages at a time; each micro-batch goes through
    `number_entries`."""
    reader = spark.readStream.format("xml").options(**_OPTIONS).option("maxFilesPerTrigger", files_per_batch)
    return _with_arrival(reader.schema(FEED_ENTRY).load(path))


def entry_from_text(text: Column) -> Column:
    """An entry held as text, for feeds that were landed as a table of entries."""
    return F.from_xml(text, FEED_ENTRY, {"ignoreNamespace": "true", "mode": "FAILFAST"})


def read_entries(entries: DataFrame, text: str = "entry") -> DataFrame:
    """The elements of entries that are held as text, for `parse_entries`; other columns are carried along.

    Each entry is parsed once. The elements go through a generator, since a filter on them would else be moved below
    the parse and parse the entry again for each element it names.
    """
    carried = [name for name in entries.columns if name != text]
    return entries.select(*carried, F.inline(F.array(entry_from_text(F.col(text)))))


def scan_marks(spark: SparkSession, path: str) -> DataFrame:
    """Deletion marks of all feed pages below `path`: entry_id, and `landed`, which orders them by page.

    Entries are read without them unless they are asked for. A mark counts as having come before the entries of its page.
    """
    marks = T.StructType([T.StructField("_ref", T.StringType())])
    read = spark.read.format("xml").options(**(_OPTIONS | {"rowTag": "deleted-entry"})).schema(marks).load(path)
    position = F.lit(-1).cast("bigint")
    page = (F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_path").alias("file"))
    return read.select(F.col("_ref").alias("entry_id"), F.struct(*page, position.alias("position")).alias("landed"))
