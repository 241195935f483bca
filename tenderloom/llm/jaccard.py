"""Near duplicates: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Documents with the same set are one node. Nodes that agree in a band of MinHash values are candidates; bands and rows are
chosen for a target recall. Candidates are joined through the least node of each bucket, never pair by pair, into groups,
and within a group all pairs are compared on their full shingle sets, block against block, so a group of any size is
spread over tasks of bounded size and no link is lost to a cap. Tasks give counts of links and a spanning forest instead
of pairs; the forest's components are the classes.

Words are lower-cased runs of characters other than blank, tab and line ends. A text of one to four words is one shingle.
A text without words (null too) is like no other: it is a class of its own, as is every row without an id, whose
class is null. Rows with the same id count as copies if their sets agree; texts under one id that are unlike are in classes
of their own, each named by the least id in it. Shingles are compared by 64-bit hashes, sets by 128 bits, and the text of
a set is found by its id and SHA-256. Other columns of documents do no harm, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import list_array, slices, small_batches
from .components import components
from .shared import written
from .word_hashes import MIX, STEP, SPACES, mixed, word_hashes

def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows a band can have so that pairs at the threshold are found with `recall`, within
    `most_hashes`. More rows mean fewer false candidates."""
    best = None
    for rows in range(1, most_hashes + 1):
        found = math.log1p(-(threshold**rows))
        bands = math.ceil(math.log(1 - recall) / found) if found else most_hashes + 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and where those of each text begin."""
    words, edges = word_hashes(texts, SPACES)
    count = np.diff(edges)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)])
    if not out[-1]:
        return np.empty(0, np.uint64), out
    row = np.repeat(np.arange(len(count)), many)
    begin = edges[row] + np.arange(out[-1]) - out[row]
    span = np.minimum(count[row], size)
    total = span.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        total = total * STEP + np.where(k < span, padded[begin + k], np.uint64(0))
    return mixed(total), out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * STEP)
    return values[:n], values[n:] | np.uint64(1)


def signatures(docs: DataFrame, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest, the set's key (high, low), n_shingles and a hash for each band."""
    flip, factor = _seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingles, edges = shingle_hashes(part.column(1), size)
                n = part.num_rows
                keys, distinct = np.zeros((2, n), np.uint64), np.zeros(n, np.int64)
                one, two = mixed(shingles), mixed(shingles ^ STEP)
                for k in np.flatnonzero(np.diff(edges)):
                    a, b = edges[k], edges[k + 1]
                    _, first = np.unique(shingles[a:b], return_index=True)
                    distinct[k] = len(first)
                    keys[:, k] = one[a:b][first].sum(), two[a:b][first].sum()
                full = np.flatnonzero(np.diff(edges))
                found = np.zeros((n, bands), np.uint64)
                values = np.empty_like(shingles)
                for k in range(bands * rows if len(full) else 0):
                    np.bitwise_xor(shingles, flip[k], out=values)
                    np.multiply(values, factor[k], out=values)
                    band = found[full, k // rows]
                    found[full, k // rows] = band * STEP + np.minimum.reduceat(values, edges[full])
                found = mixed(found + np.arange(bands, dtype=np.uint64) * MIX).view(np.int64)
                lists = list_array(found.ravel(), np.arange(n + 1) * bands, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(k.view(np.int64)) for k in keys), pa.array(distinct), lists],
                    ["doc_id", "digest", "high", "low", "n_shingles", "bands"],
                )

    body = F.col(f"`{text}`").alias("text")
    rows_of = small_batches(docs).select(F.col("doc_id").cast("long"), body, text_digest(text).alias("digest"))
    return rows_of.mapInArrow(
        run, "doc_id long, digest binary, high long, low long, n_shingles long, bands array<long>"
    )


def text_digest(text: str) -> Column:
    """Tells the texts of one id apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Replaces the column text by its distinct shingles, ascending, as bytes of 64-bit numbers."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingles, edges = shingle_hashes(part.column(part.schema.get_field_index("text")), size)
                sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns, pa.array(sets, pa.binary())], [*names, "shingles"]
                )

    return docs.mapInArrow(run, f"{schema}, shingles binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one (or with each left one), exact."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(many > 1) - 1  # an element of one set only takes part in no intersection
    keep = many[column] > 1
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right) if right else len(left)), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for a, b in zip(edges[:-1], edges[1:]):
        if a == b:
            continue
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], column[a:b] % width] = 1
        total += held[: len(left)] @ (held[len(left) :] if right else held).T
    return total


def _forest(near: np.ndarray) -> np.ndarray:
    """For each node of an adjacency matrix the least one that it is joined to."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(near, label[None, :], len(near)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def links_within(nodes: DataFrame, threshold: float) -> DataFrame:
    """Compares the sets of each block pair. nodes: root, i, j, block, node, n_docs, shingles. Gives for each node that
    has links n_set_links, n_doc_links and `other`, a smaller node it is joined to (null for none)."""
    columns = ["root", "i", "j", "block", "node", "n_docs", "shingles"]
    share = threshold / (1 + threshold)

    def compare(group: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({row[4]: row for row in rows}.values())
        if group[1] != group[2]:
            rows.sort(key=lambda row: row[3])
        split = sum(row[3] == group[1] for row in rows)
        sets = [np.frombuffer(row[6], np.uint64) for row in rows]
        if len(rows) < 2 or group[1] != group[2] and split in (0, len(rows)):
            return None
        size = np.array([len(s) for s in sets])
        near = np.zeros((len(rows), len(rows)), bool)
        if group[1] == group[2]:
            near[:] = shared_counts(sets, None) >= share * (size[:, None] + size[None, :]) - 1e-9
            np.fill_diagonal(near, False)
        else:
            both = shared_counts(sets[:split], sets[split:])
            near[:split, split:] = both >= share * (size[:split, None] + size[None, split:]) - 1e-9
            near |= near.T
        linked = np.flatnonzero(near.any(1))
        if not len(linked):
            return None
        node, docs = np.array([row[4] for row in rows]), np.array([row[5] for row in rows])
        order = np.argsort(node)
        root = node[order][_forest(near[np.ix_(order, order)])][np.argsort(order)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(node[linked]),
                pa.array(near.sum(1)[linked]),
                pa.array((near @ docs)[linked]),
                pa.array(root[linked], mask=root[linked] == node[linked]),
            ],
            ["node", "n_set_links", "n_doc_links", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns)))):
                if row[:3] != group:
                    if rows and (found := compare(group, rows)) is not None:
                        yield found
                    group, rows = row[:3], []
                rows.append(row)
        if rows and (found := compare(group, rows)) is not None:
            yield found

    ordered = nodes.select(*columns).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(run, "node long, n_set_links long, n_doc_links long, other long")


def document_classes(
    docs: DataFrame,
    text: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    block_nodes: int = 512,
    block_shingles: int = 1 << 20,
) -> DataFrame:
    """doc_id and digest of each row, with class_id (the least id of its class), class_digest (of the text under that id
    that stands for the class), n_links and n_set_links."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, text, size, bands, rows), "signatures")
    n = signed.count()
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A set is a node of its own, also where several have the same least id. The numbers are fixed once they are written.
    sets = written(
        full.groupBy("high", "low")
        .agg(
            F.min(F.struct("doc_id", "digest")).alias("least"),
            F.count("*").alias("n_docs"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "sets",
        n,
    )

    # Buckets with two nodes or more, and the least node of each.
    held = sets.select("node", F.explode("bands").alias("bucket"))
    heads = held.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    heads = written(heads.select("bucket", "head"), "buckets", n * bands)
    edges = held.join(heads, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = components(edges, n * bands)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())

    # Large groups are cut into blocks; every pair of blocks is a unit of work.
    named = sets.select("node", "n_docs", "n_shingles", "least.doc_id", "least.digest")
    known = written(groups.join(named, "node"), "nodes", 2 * n)
    weight = F.greatest(F.count("*") / block_nodes, F.sum("n_shingles") / block_shingles)
    parts = written(known.groupBy("root").agg(F.ceil(weight).cast("int").alias("parts")), "parts", n)
    placed = known.join(parts, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_digest(text).alias("digest"), F.col(f"`{text}`").alias("text")
    )
    found = texts.join(placed.drop("n_shingles"), ["doc_id", "digest"]).drop("doc_id", "digest")
    held = shingle_sets(found, size)
    pairs = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    links = written(links_within(pairs, threshold), "links")

    counts = links.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_set_links", "n_doc_links")])
    edges = links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    classes = components(edges, links.count())
    of_sets = written(
        sets.select("high", "low", "least", "node", "n_docs")
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select(
            "high",
            "low",
            "least",
            F.coalesce("root", "node").alias("root"),
            (F.col("n_docs") - 1 + F.coalesce("n_doc_links", F.lit(0))).alias("n_links"),
            F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"),
        ),
        "classes",
        n,
    )
    first = of_sets.groupBy("root").agg(F.min("least").alias("of_class"))
    of_sets = of_sets.join(first, "root").select(
        "high", "low", F.col("of_class.doc_id").alias("class_id"), F.col("of_class.digest").alias("class_digest"),
        "n_links", "n_set_links",
    )
    none = F.lit(0).cast("long")
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"),
        none.alias("n_links"), none.alias("n_set_links"),
    )
    found = full.select("doc_id", "digest", "high", "low").join(of_sets, ["high", "low"]).drop("high", "low")
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """For each row doc_id, class_id (the least id of its class), n_links (other documents that are near it) and
    n_set_links (other shingle sets that are). `docs` has a column doc_id; options are those of `document_classes`."""
    return document_classes(docs, text, **options).select("doc_id", "class_id", "n_links", "n_set_links")


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of each class: a row with its least id and the text that stands for it. Rows without an id all stay. The
    columns are those of `docs`."""
    classes = document_classes(docs, text, **options)
    kept = classes.select(F.col("class_id").alias("doc_id"), F.col("class_digest").alias("__digest")).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    keyed = docs.where("doc_id IS NOT NULL").withColumn("__digest", text_digest(text))
    # Reduced before the shuffle, so that repeated rows do not meet in one task. Null and empty texts have one digest.
    one = F.min_by(F.struct(*others), F.col(f"`{text}`").isNull()).alias("row")
    rows = keyed.groupBy("doc_id", "__digest").agg(one).join(kept, ["doc_id", "__digest"], "left_semi")
    return rows.select("doc_id", "row.*").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
