"""Whitening of embeddings by the covariance of their different vectors.

Entries become whole numbers, floor(scale * c), so that equal vectors are equal to the last bit. Rows with the same
numbers are one vector with a count; copies, however many, are counted before the shuffle. The covariance is a weighted
centred matrix product: each vector counts once (`weigh="one"`) or as often as it occurs (`weigh="copies"`). Tasks add up
their own products and Spark adds up the cells, so only a square of the number of dimensions reaches the driver. Every
different vector is whitened once, and rows get the result by a join on the numbers.

The sums S and the number n are exact, and vectors are centred as (n x - S) / n before they are multiplied. Components
are unit eigenvectors of the covariance by falling eigenvalue, each with its largest entry positive.

Rows whose vector is null, or has a null, infinite or NaN entry, are left out. Repeated rows and null ids stay. Numbers
beyond 64 bits become the nearest 64-bit ones. Vectors shorter than the longest one count as having zeros there, and are
a vector of their own. Equal eigenvalues leave open which unit vectors are taken; all rows get the same. Along a
component without variance (all vectors alike, or fewer than components) `whitened` is null; `explained` is null if no
component has variance. A deviation beyond 64 bits is null. No rows, or vectors of no entries, give no result rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import list_array
from .shared import written

SCALE = 256
COMPONENTS = 4
_HALF = 1 << 32  # numbers are added up as two halves, so that no sum overflows
_SAFE = 1 << 62
_NARROW = 1 << 15
_FLAT = 1e-12  # of the largest eigenvalue: what is left of a zero after rounding


@dataclasses.dataclass(frozen=True)
class Fit:
    """Number of fit rows, exact sums, eigenvalues of all components, and the first few as columns of a matrix."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray

    @property
    def largest_sum(self) -> int:
        return max((abs(s) for s in self.sums), default=0)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def finite(vector: Column) -> Column:
    """Whether a vector has neither null nor infinite nor NaN entries; false for a null vector."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def keyed(rows: DataFrame, numbers: Column) -> DataFrame:
    """`rows` with the numbers in the columns by which vectors are grouped and joined: short ones if all fit, else long
    ones. Most vectors then take a quarter of the space in shuffles."""
    short = F.forall(numbers, lambda x: (x >= -_NARROW) & (x < _NARROW))
    return rows.withColumns(
        {"narrow": F.when(short, numbers.cast("array<smallint>")), "wide": F.when(~short, numbers)}
    )


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each different vector of `keyed` rows once, with its number of rows."""
    return rows.groupBy("narrow", "wide").agg(F.count(F.lit(1)).alias("copies"))


def _numbers() -> Column:
    return F.coalesce(F.col("narrow").cast("array<bigint>"), F.col("wide"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of a matrix; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(sizes), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = flat
    return found


def _by_column(vectors: DataFrame, add, schema: str) -> DataFrame:
    """Rows of `add`, a generator over (numbers, weights) of a task's batches. `vectors` has x and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add((b.column(0), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)

    return vectors.select("x", "weight").mapInArrow(run, schema)


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of fit rows and the sum of each dimension, both exact."""

    def add(batches):
        high, low, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for column, weight in batches:
            width = max(len(high), int(np.diff(column.offsets.to_numpy()).max()))
            x = _matrix(column, width)
            high, low = (np.pad(part, (0, width - len(part))) for part in (high, low))
            high += ((x >> 32) * weight[:, None]).sum(axis=0)
            low += ((x & (_HALF - 1)) * weight[:, None]).sum(axis=0)
            n += int(weight.sum())
        at = np.arange(-1, len(high))
        yield pa.record_batch(
            {"at": pa.array(at, pa.int32()), "high": pa.array([0, *high], pa.int64()), "low": pa.array([n, *low], pa.int64())}
        )

    found = _by_column(vectors, add, "at int, high long, low long").groupBy("at")
    sums = {r["at"]: int(r["high"]) * _HALF + int(r["low"]) for r in found.agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    ).collect()}
    return sums.get(-1, 0), [sums[k] for k in range(len(sums) - 1)]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray | None]:
    """x - S/n, and n x - S where 64 bits hold it."""
    s = np.array(sums, object)
    largest = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if n * largest + max((abs(v) for v in sums), default=0) < _SAFE:
        whole = x * n - s.astype(np.int64)
        return whole / n, whole
    return x - np.array([v / n for v in sums]), None


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted centred products of all pairs of dimensions, divisor n."""
    width, held = len(sums), tuple(sums)
    rows, columns = np.triu_indices(width)

    def add(batches):
        total = np.zeros((width, width))
        for column, weight in batches:
            c, _ = _centred(_matrix(column, width), n, held)
            total += (c * weight[:, None]).T @ c
        yield pa.record_batch(
            {"row": pa.array(rows, pa.int32()), "col": pa.array(columns, pa.int32()), "total": pa.array(total[rows, columns])}
        )

    cells = _by_column(vectors, add, "row int, col int, total double").groupBy("row", "col").agg(F.sum("total").alias("total"))
    found = np.zeros((width, width))
    for cell in cells.collect():
        found[cell["row"], cell["col"]] = found[cell["col"], cell["row"]] = cell["total"] / n
    return found


def fit_vectors(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """The fit over `vectors` (x, weight)."""
    n, sums = exact_sums(vectors)
    values, units = np.linalg.eigh(covariance(vectors, n, sums)) if sums else (np.zeros(0), np.zeros((0, 0)))
    values, units = np.maximum(values[::-1], 0.0), units[:, ::-1][:, :components]
    if units.size:
        peak = np.abs(units).argmax(axis=0)
        units = units * np.where(units[peak, np.arange(units.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, tuple(sums), values, units)


def _deviations(x: np.ndarray, whole: np.ndarray | None, fit: Fit) -> pa.Array:
    """Sums of (n x - S)^2, exact; null beyond 64 bits."""
    largest = int(np.abs(whole).max(initial=0)) if whole is not None else _SAFE
    if largest * largest * max(1, x.shape[1]) < _SAFE:
        return pa.array((whole * whole).sum(axis=1), pa.int64())
    found = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def whiten_vectors(vectors: DataFrame, fit: Fit) -> DataFrame:
    """`narrow`, `wide` and `weight` with the deviation and the whitened coordinates of each vector."""
    width, kept = len(fit.sums), fit.components.shape[1]
    spread = fit.values[:kept]
    usable = spread > _FLAT * max(spread[0], 1.0) if kept else np.zeros(0, bool)
    scaled = fit.components / np.sqrt(np.where(usable, spread, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), width)
            centred, whole = _centred(x, fit.n, fit.sums)
            shown = pa.array((centred @ scaled).ravel(), mask=np.tile(~usable, len(x)))
            edges = np.arange(len(x) + 1) * kept
            whitened = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), shown)
            yield pa.record_batch(
                [*batch.columns[:3], _deviations(x, whole, fit), whitened],
                ["narrow", "wide", "weight", "deviation", "whitened"],
            )

    return vectors.select("narrow", "wide", "weight", "x").mapInArrow(
        run, "narrow array<smallint>, wide array<bigint>, weight long, deviation long, whitened array<double>"
    )


def identity_error(whitened: DataFrame, kept: int) -> float:
    """Largest distance of an entry of the covariance of whitened vectors from that of the identity, over components
    with variance; 0 if there are none."""
    weight, at = F.col("weight"), [F.get("whitened", F.lit(k)) for k in range(kept)]
    if not kept:
        return 0.0
    means = whitened.agg(*[(F.sum(weight * c) / F.sum(weight)).alias(str(k)) for k, c in enumerate(at)]).first()
    pairs = [(i, j) for i in range(kept) for j in range(i, kept) if means[i] is not None and means[j] is not None]
    if not pairs:
        return 0.0
    product = lambda i, j: F.sum(weight * (at[i] - means[i]) * (at[j] - means[j])) / F.sum(weight)
    found = whitened.agg(*[product(i, j).alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(
    rows: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    weigh: str = "one",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """One row for each remaining row and component: `row_id`, component (from 1), n, deviation, whitened, explained
    and identity_error."""
    if weigh not in ("one", "copies"):
        raise ValueError(f"weigh is 'one' or 'copies', not {weigh!r}")
    given = rows.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{vector}`").alias("vector"))
    numbered = given.where(finite(F.col("vector"))).select("row_id", whole_numbers(F.col("vector"), scale).alias("x"))
    facts = keyed(numbered, F.col("x")).drop("x")
    weight = F.lit(1).cast("long") if weigh == "one" else F.col("copies")
    different = written(distinct_vectors(facts), "vectors")
    vectors = different.select("narrow", "wide", weight.alias("weight"), _numbers().alias("x"))
    fit = fit_vectors(vectors, components)
    whitened = written(whiten_vectors(vectors, fit), "whitened")
    kept, total = fit.components.shape[1], float(fit.values.sum())
    error = identity_error(whitened, kept)
    shares = F.lit([float(v) / total if total > 0 else None for v in fit.values[:kept]]).cast("array<double>")
    same = facts["narrow"].eqNullSafe(whitened["narrow"]) & facts["wide"].eqNullSafe(whitened["wide"])
    joined = facts.join(whitened, same).select("row_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return joined.select(
        F.col("row_id").alias(row_id),
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
