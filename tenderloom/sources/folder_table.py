"""A Parquet table with insert-or-replace by key, for storage without a MERGE-capable table format.

Rows lie in folders: by a hash of their key, or by kind and month. A batch joins the folders that it touches, and those
are replaced by a dynamic partition overwrite; of the others at most the keys are read, and nothing is written.

Replacing folders takes Spark several steps, and a driver may be lost between them. What a batch will write is therefore
written beside the table first, and a batch that is run again writes the same rows again instead of working them out from
a table that is half replaced. Where the folders held no rows there is nothing to lose, and the batch itself is enough.
Readers that work while a batch is stored may see some of its folders old and some new.

Whole rows are shuffled once to be merged and laid out by folder. What was laid out beside the table goes from there to the
table, and goes again when a batch is run again, without another shuffle or sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.operators.touched import hash_bucket, rows_with
from tenderloom.operators.upsert import latest_rows
from tenderloom.schemas import NOTICES, OTHER
from tenderloom.sources.tables import read_or_empty

_REMOVED = "removed"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_CODEC = "zstd"
_DONE = T.StructType([T.StructField("version", T.LongType())])


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks keep files of up to `most` folders open, and sort rows by folder only beyond that."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, most)
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


@dataclass(frozen=True)
class Steps:
    """Results of the steps of one version, kept below `path` so that a second run finds those of the first.

    Two versions are kept in turn. A result counts when the mark written after it names its version."""

    path: str
    version: int

    def _folder(self, name: str) -> str:
        return f"{self.path}/_steps/{name}-{self.version % 2}"

    def has(self, spark: SparkSession, name: str) -> bool:
        """Whether a step of this version has been kept."""
        done = read_or_empty(spark, f"{self._folder(name)}-done", _DONE)
        return not done.where(F.col("version") == self.version).isEmpty()

    def keep(
        self,
        spark: SparkSession,
        name: str,
        make: Callable[[], DataFrame],
        schema: T.StructType | None = None,
        by: Sequence[str] = (),
    ) -> DataFrame:
        """The kept rows of a step; made and written if this version has not got that far. With `by` they lie in folders
        by those columns, and `schema` gives their types."""
        folder = self._folder(name)
        if not self.has(spark, name):
            writer = make().write.mode("overwrite").option("compression", _CODEC)
            writer.option("partitionOverwriteMode", "static").partitionBy(*by).parquet(folder)
            spark.createDataFrame([(self.version,)], _DONE).coalesce(1).write.mode("overwrite").parquet(f"{folder}-done")
        return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


@dataclass(frozen=True)
class FolderTable:
    """A table at `path` with one row for each `key`. `places` gives the folder columns of a row. Where `moves` is set, a
    new row may lie in another folder than the one that it replaces, and the keys of the table are looked through for it.
    """

    path: str
    key: str
    schema: T.StructType
    places: dict[str, Column]
    moves: bool = False

    def read(self, spark: SparkSession) -> DataFrame:
        """The current rows, one for each key."""
        return self._stored(spark).select(*self.schema.names)

    def changes(self, batch: DataFrame, order: str) -> DataFrame:
        """The last row of each key of a batch by `order`, for `replace`."""
        return latest_rows(batch.select(*self.schema.names, order), self.key, order).withColumn(_REMOVED, F.lit(False))

    def upsert(self, batch: DataFrame, order: str, version: int) -> None:
        """Store a batch under its number. The last row of a key by `order` wins and replaces the whole row. A batch
        may be run again, as long as no later one has been."""
        spark = batch.sparkSession
        self.replace(Steps(self.path, version).keep(spark, "changes", lambda: self.changes(batch, order)), version)

    def replace(self, changes: DataFrame, version: int) -> None:
        """Store rows that are unique by key; those with `removed` set take their key out. `changes` is read more than
        once and should be a stored table."""
        spark, steps, names = changes.sparkSession, Steps(self.path, version), list(self.places)
        rows = changes.where(F.col(self.key).isNotNull()).withColumns(self.places)
        touched = [tuple(r) for r in steps.keep(spark, "places", lambda: self._touched(spark, rows)).collect()]
        if not touched:
            return
        before = self._stored(spark).where(self._within(touched))
        if not steps.has(spark, "merged") and before.isEmpty():
            self._write(self._laid_out(self._replacement(spark, rows, touched)))
            return
        made = lambda: self._merged(rows, before, self._replacement(spark, rows, touched))
        merged = steps.keep(spark, "merged", made, self._layout(), names)
        with _open_files(spark, len(touched)):
            self._write(merged)

    def _write(self, laid_out: DataFrame) -> None:
        writer = laid_out.write.mode("overwrite").option("compression", _CODEC)
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*self.places).parquet(self.path)

    def _layout(self) -> T.StructType:
        inner = [field for field in self.schema.fields if field.name not in self.places]
        kinds = {name: T.IntegerType() if name == "bucket" else T.StringType() for name in self.places}
        return T.StructType([*inner, *[T.StructField(name, kind) for name, kind in kinds.items()]])

    def _stored(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path, self._layout()).where(F.col(self.key).isNotNull())

    def _touched(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """The folders that the rows lie in or are to be taken out of: as many at most as the table has."""
        names = list(self.places)
        found = rows.select(*names)
        if self.moves:
            former = rows_with(self._stored(spark).select(*names, self.key), rows, self.key)
            found = found.unionByName(former.select(*names))
        return found.distinct()

    def _within(self, touched: list[tuple]) -> Column:
        """A condition on folder columns alone, for which Spark leaves the other folders unread."""
        first, *rest = self.places
        chosen = F.lit(False)
        for value in {place[0] for place in touched} if rest else ():
            inner = [place[1] for place in touched if place[0] == value]
            chosen = chosen | ((F.col(first) == value) & F.col(rest[0]).isin(inner))
        return chosen if rest else F.col(first).isin([place[0] for place in touched])

    def _replacement(self, spark: SparkSession, rows: DataFrame, touched: list[tuple]) -> DataFrame:
        """The new rows, and for each folder one without a key: a folder that nothing is written to would not be replaced,
        and keep the rows that were taken out."""
        layout = self._layout()
        empty = (None,) * (len(layout) - len(self.places))
        marks = spark.createDataFrame([empty + place for place in touched], layout)
        return rows.where(~F.col(_REMOVED)).select(*layout.names).unionByName(marks)

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """The rows in the order of folder and key, dealt out by ranges: a large folder is divided among tasks, and small
        ones share a task."""
        return rows.repartitionByRange(*self.places, self.key).sortWithinPartitions(*self.places, self.key)

    def _merged(self, rows: DataFrame, before: DataFrame, replacement: DataFrame) -> DataFrame:
        """All rows of the touched folders after the change."""
        names = self._layout().names
        if self.moves:
            kept = before.join(rows.select(self.key), self.key, "left_anti")
            return self._laid_out(kept.select(*names).unionByName(replacement))
        # The old row of a key and the new one lie in the same folder, so that they meet where the folder is laid out.
        values = [name for name in names if name not in (self.key, *self.places)]
        state = lambda frame, at: frame.select(*self.places, self.key, F.lit(at).alias("at"), F.struct(*values).alias("row"))
        nothing = F.lit(None).cast(before.select(F.struct(*values).alias("row")).schema["row"].dataType)
        gone = rows.where(F.col(_REMOVED)).select(*self.places, self.key, F.lit(2).alias("at"), nothing.alias("row"))
        both = state(before, 0).unionByName(state(replacement, 1)).unionByName(gone)
        newest = self._laid_out(both).groupBy(*self.places, self.key).agg(F.max(F.struct("at", "row")).alias("newest"))
        return newest.where(F.col("newest.at") < 2).select(self.key, "newest.row.*", *self.places).select(*names)


def bucketed_table(path: str, key: str, schema: T.StructType, buckets: int = 64) -> FolderTable:
    """Folders by a hash of the key. `buckets` belongs to the table and cannot be changed: a bucket should hold what a few
    tasks can rewrite."""
    return FolderTable(path, key, schema, {"bucket": hash_bucket(F.col(key), buckets).cast("int")})


def monthly_notices(path: str) -> FolderTable:
    """Notices in folders by kind and month of publication, so that filters on either leave the others unread."""
    places = {
        "kind": F.coalesce("kind", F.lit(OTHER)),
        "month": F.coalesce(F.date_format("publication_date", "yyyy-MM"), F.lit("unknown")),
    }
    return FolderTable(path, "publication_number", NOTICES, places, moves=True)
