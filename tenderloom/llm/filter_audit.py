"""How five filters of documents act together: what each removes in every order, and what only it would have removed.

A document's failures are a mask of bits, one a filter, so all orders follow from how many documents of a part have each
mask. A walk in Gray code visits all sets of filters and switches one filter on or off at a time. Each mask cell counts
the active filters that it fails; a cell whose count leaves 0 leaves the survivors, and one that comes back to 0 joins
them. The survivors of all 32 sets are kept, and a step of any order is the difference of two of them.

Texts are read once and only by rows: words, capitals and signs in tasks, copies by an aggregate over digests. After that
a document is an id, its part, a mask and a digest. The copies of one text, however many, meet as one row for each task.

Filters, in the order of their letters: A, too few words; B, too few different words; C, too many capitals; D, signs;
E, the same text as a document with a smaller id. Words are runs of bytes other than blank, tab and line ends, told apart
by case. Texts are equal if their SHA-256 is.

Null and empty texts have no words: they fail A, and copies of them fail E. A null part counts as the empty string. A row
without an id is no copy (no id is smaller) and makes no other row one; rows with the same id and text are told apart as
rows, and none is a copy of the other. A document is good, or toxic, if any row of labels with its id says so. An empty
table gives no parts and no rows. Texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .shared import written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")
_CAPITALS = bytes(range(65, 91))
_TAILS = bytes(range(0x80, 0xC0))  # all bytes of a character but its first
_JUDGED = "doc_id long, part string, mask int, digest binary"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


@dataclasses.dataclass(frozen=True)
class Limits:
    """When a text fails: fewer than `words`; fewer different words than `different` percent; more capitals than
    `capitals` percent of its characters; any of `signs`."""

    words: int = 200
    different: int = 50
    capitals: int = 3
    signs: bytes = b"#$%&*|"


def text_mask(raw: bytes, limits: Limits = Limits()) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()
    characters = len(raw.translate(None, _TAILS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < limits.words)
        | (100 * len(set(words)) < limits.different * len(words)) << 1
        | (100 * capitals > limits.capitals * characters) << 2
        | (len(raw.translate(None, limits.signs)) < len(raw)) << 3
    )


def judge_texts(docs: DataFrame, doc_id: str, text: str, part: str, limits: Limits = Limits()) -> DataFrame:
    """For each row its id, part, the mask of A to D, and the digest of its text."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                raws = [raw or b"" for raw in some.column(2).cast(pa.binary()).to_pylist()]
                yield pa.record_batch(
                    {
                        "doc_id": some.column(0),
                        "part": some.column(1),
                        "mask": pa.array([text_mask(raw, limits) for raw in raws], pa.int32()),
                        "digest": pa.array([hashlib.sha256(raw).digest() for raw in raws], pa.binary()),
                    }
                )

    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    return rows.mapInArrow(judge, _JUDGED)


def mask_cells(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each part and mask: all, good ones and toxic ones. `judged` is read twice."""
    rows = judged.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = (
        judged.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min("doc_id").alias("first_id"))
    )
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")])
    )
    # Joined on id and digest together, so that the copies of one text do not meet in one task.
    is_first = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    flagged = rows.join(first, is_first, "left").join(known, F.col("doc_id") == F.col("labelled"), "left")
    return flagged.groupBy("part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def walk_subsets(masks: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every set of filters, by the set's bits: one row of measures a set.

    `counts` has a row of measures for each cell. Two sets in turn differ in one filter, so each step changes the
    counters of the cells that fail it, and the survivors by the cells whose counter leaves or reaches 0."""
    active = np.zeros(len(masks), np.int64)
    alive = counts.sum(axis=0)
    states = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    states[0] = alive
    chosen = 0
    for k in range(1, 1 << n_filters):
        bit = k & -k
        chosen ^= bit
        touched = (masks & bit) > 0
        if chosen & bit:
            alive = alive - counts[touched & (active == 0)].sum(axis=0)
            active[touched] += 1
        else:
            active[touched] -= 1
            alive = alive + counts[touched & (active == 0)].sum(axis=0)
        states[chosen] = alive
    return states


def shapley_sums(kept: np.ndarray, n_filters: int) -> list[int]:
    """For each filter what it removes, added up over all orders. A set S comes before filter f in |S|! (n - 1 - |S|)!
    of the orders."""
    found = []
    for f in range(n_filters):
        total = 0
        for chosen in range(1 << n_filters):
            if not chosen >> f & 1:
                size = chosen.bit_count()
                orders = math.factorial(size) * math.factorial(n_filters - 1 - size)
                total += orders * int(kept[chosen] - kept[chosen | 1 << f])
        found.append(total)
    return found


def order_steps(part: str, masks: np.ndarray, counts: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """Every step of every order of the filters, from the cells of one part."""
    states = walk_subsets(masks, counts, len(filters))
    kept, full = states[:, 0], (1 << len(filters)) - 1
    shapley = shapley_sums(kept, len(filters))
    rows = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            fails, alone = int(kept[0] - kept[1 << f]), int(kept[full ^ 1 << f] - kept[full])
            name = "".join(filters[k] for k in order)
            rows.append(
                (part, name, step, int(kept[after]), removed, fails - removed, alone, good, toxic, shapley[f])
            )
            before = after
    return pd.DataFrame(rows, columns=[field.split()[0] for field in STEPS.split(", ")])


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    limits: Limits = Limits(),
) -> DataFrame:
    """One row for each part, order of the filters and step: documents kept after it, removed by it, failing its filter
    but removed before (`redundant`), failing its filter alone, good and toxic ones removed, and `shapley`, what its
    filter removes over all orders. `labels` has doc_id, quality and toxic."""

    def steps(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return order_steps(key[0], cells["mask"].to_numpy(np.int64), cells[list(COUNTS)].to_numpy(np.int64))

    judged = written(judge_texts(docs, doc_id, text, part, limits), "filter-audit")
    return mask_cells(judged, labels).groupBy("part").applyInPandas(steps, STEPS)
