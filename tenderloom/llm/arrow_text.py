"""Texts of an Arrow batch as bytes, and ragged arrays over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more than texts). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(frame: DataFrame) -> DataFrame:
    """The same rows, in a session that hands them to Python in batches of a few megabytes. Texts are long rows: by the
    usual counts, batches on both sides of the pipe hold more than the work on them does."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return frame


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.slice(begin, end - begin)


def ragged_positions(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1])


def totals(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[k]:edges[k + 1]]; an empty range gives 0."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[edges[1:]] - running[edges[:-1]]


def list_array(flat: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat, kind))
