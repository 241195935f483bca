"""Benchmark decontamination: rare n-gram seeds find test items in training texts, local alignment scores them.

Seeds are n-grams of a test item that are rare, judged by the corpus frequencies of their words: an n-gram counts when its
words together carry enough bits, and each item keeps at least its rarest ones. Word frequencies hardly move when a leaked
text has many copies, so copies of a leak cannot hide it. Texts are scanned for seeds; where one is found, the item is
aligned with the words around it (Smith-Waterman: a match +2, a replaced, left out or added word -1). Edited and
paraphrased copies lose some seeds and some score but not all. A score is the share of what the whole item could reach.

The index of seeds goes to every task, so its size is bounded: items are taken in blocks of at most `block_chars`
characters, each with a pass over the texts. One item is never split. Training texts are read whole, never shuffled, and
no row is made for a pair without a seed.

Words are lower-cased runs of letters, digits and characters outside ASCII, Latin-1 signs and general punctuation
excepted. Null and empty texts match nothing; items without words are in no
result. Ids may repeat: equal pairs give one row, with the best score. An item shorter than a seed is one seed itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .arrow_text import slices, small_batches
from .word_hashes import NO_LETTERS, word_hashes

MATCH, OTHER = 2, -1


class Vocabulary:
    """Numbers the words of the test items, 0, 1, ...; any other word is -1."""

    def __init__(self, texts: list[str]):
        words, self.edges = word_hashes(pa.array(texts, pa.string()), NO_LETTERS)
        self.hashes, self.words = np.unique(words, return_inverse=True)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers, and where those of each text begin."""
        words, edges = word_hashes(texts, NO_LETTERS)
        if not len(self.hashes):
            return np.full(len(words), -1), edges
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1), edges


def word_counts(rows: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How often each word of the vocabulary occurs in all texts, and how many words they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(len(vocabulary.hashes) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                numbers, _ = vocabulary.numbers(part.column(1))
                total += len(numbers)
                held += np.bincount(numbers + 1, minlength=len(held))
        word = np.flatnonzero(held[1:])
        yield pa.RecordBatch.from_arrays([pa.array([*word, -1]), pa.array([*held[1:][word], total])], ["word", "n"])

    summed = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(vocabulary.hashes), np.int64), 0
    for row in summed:
        if row["word"] < 0:
            total = row["n"]
        else:
            counts[row["word"]] = row["n"]
    return counts, total


class SeedIndex:
    """Seeds of a block of items, for a scan of texts as arrays of word numbers."""

    def __init__(self, ids: list[int], vocabulary: Vocabulary, counts: np.ndarray, total: int, size: int, bits: float,
                 least: int):
        self.ids, self.vocabulary = np.array(ids, np.int64), vocabulary
        self.items = [vocabulary.words[a:b] for a, b in zip(vocabulary.edges[:-1], vocabulary.edges[1:])]
        rare = -np.log2((counts + 1) / (total + 2))
        keys, owners, places = [], [], []
        for k, words in enumerate(self.items):
            if not len(words):
                continue
            span = min(size, len(words))
            windows = np.lib.stride_tricks.sliding_window_view(words, span)
            weight = rare[windows].sum(1)
            chosen = np.flatnonzero(weight >= min(bits, np.sort(weight)[-least:].min()))
            keys += [self._keys(windows[chosen])]
            owners += [np.full(len(chosen), k)]
            places += [chosen]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate(owners)[order] if keys else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if keys else np.empty(0, np.int64)
        self.spans = sorted({min(size, len(words)) for words in self.items if len(words)})

    @staticmethod
    def _keys(windows: np.ndarray) -> np.ndarray:
        key = np.full(len(windows), windows.shape[1], np.uint64)
        for column in windows.T:
            key = (key + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def find(self, words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, its place and the texts' place of each seed, in texts that begin at `edges` of a row of numbers."""
        found = []
        known = np.concatenate([[0], np.cumsum(words >= 0)])
        for span in self.spans:
            at = np.flatnonzero(known[span:] - known[:-span] == span) if len(words) >= span else np.empty(0, np.int64)
            at = at[np.searchsorted(edges, at, "right") == np.searchsorted(edges, at + span - 1, "right")]
            if not len(at):
                continue
            keys = self._keys(words[at[:, None] + np.arange(span)])
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            count = high - low
            hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append((self.owner[hit], self.place[hit], np.repeat(at, count)))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(part) for part in zip(*found))


def align(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of one item with each row of `texts` (word numbers, -1 for none): score and end column."""
    gap = np.arange(texts.shape[1] + 1)
    above = np.zeros((len(texts), texts.shape[1] + 1), np.int64)
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for word in item:
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(texts == word, MATCH, OTHER), above[:, 1:] + OTHER)
        np.maximum(row, 0, out=row)
        # A run of added words costs one each: a running maximum along the row.
        row = np.maximum.accumulate(row - OTHER * gap, axis=1) + OTHER * gap
        at = row.argmax(1)
        value = row[np.arange(len(texts)), at]
        end = np.where(value > best, at, end)
        best = np.maximum(best, value)
        above = row
    return best, end


def matches(
    words: np.ndarray, owner: np.ndarray, place: np.ndarray, at: np.ndarray, index: SeedIndex, least: float
) -> list[tuple[int, float, int]]:
    """(item id, best score, end) for the items that a text with these seeds holds with a score of `least` or more."""
    found = []
    for k in np.unique(owner):
        item = index.items[k]
        mine = owner == k
        # Seeds of one item close to each other are aligned once: windows that overlap are joined.
        reach = len(item) + len(item) // 2
        starts = np.sort(at[mine] - place[mine])
        cut = np.flatnonzero(np.diff(starts) > len(item)) + 1
        best = (0.0, 0)
        for part in np.split(starts, cut):
            low, high = max(0, part[0] - len(item) // 2), min(len(words), part[-1] + reach)
            score, end = align(item, words[None, low:high])
            best = max(best, (float(score[0]) / (MATCH * len(item)), int(low + end[0])))
        if best[0] >= least:
            found.append((int(index.ids[k]), best[0], best[1]))
    return found


def _blocks(items: list[Row], most: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for row in items:
        if block and held + len(row["text"]) > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        yield block


def _indexes(
    rows: DataFrame, items: DataFrame, size: int, bits: float, least_seeds: int, block_chars: int
) -> Iterator[Broadcast]:
    """The seed index of each block of items, by the word frequencies of all texts."""
    listed = items.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    for block in _blocks(listed.toLocalIterator(), block_chars):
        vocabulary = Vocabulary([text for _, text in block])
        counts, total = word_counts(rows, vocabulary)
        made = SeedIndex([item for item, _ in block], vocabulary, counts, total, size, bits, least_seeds)
        yield rows.sparkSession.sparkContext.broadcast(made)


def _leaks(texts: pa.Array, seeds: SeedIndex, threshold: float) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
    """The texts that hold items, by their number, and what they hold."""
    words, edges = seeds.vocabulary.numbers(texts)
    owner, place, at = seeds.find(words, edges)
    text = np.searchsorted(edges, at, "right") - 1
    for k in np.unique(text):
        mine = text == k
        hits = owner[mine], place[mine], at[mine] - edges[k]
        found = matches(words[edges[k] : edges[k + 1]], *hits, seeds, threshold)
        if found:
            yield int(k), found


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    size: int = 3,
    bits: float = 24.0,
    least_seeds: int = 8,
    threshold: float = 0.5,
    block_chars: int = 16 << 20,
) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score (up to 1), and the word of the text at
    which the alignment ends. `docs` has doc_id; `items` has item_id and text."""
    rows = small_batches(docs).select("doc_id", F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, score double, end_word long"
    found = rows.sparkSession.createDataFrame([], schema)
    for index in _indexes(rows, items, size, bits, least_seeds, block_chars):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    leaks = _leaks(part.column(1), index.value, threshold)
                    out = [(part.column(0)[k].as_py(), *one) for k, held in leaks for one in held]
                    columns = list(zip(*out)) if out else [()] * 4
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "end_word"]
                    )

        found = found.unionByName(rows.mapInArrow(run, schema))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.end_word")


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    size: int = 3,
    bits: float = 24.0,
    least_seeds: int = 8,
    threshold: float = 0.5,
    block_chars: int = 16 << 20,
) -> DataFrame:
    """The rows whose texts hold no item, as they are; rows are judged where they are read, without a shuffle."""
    kept = small_batches(docs)
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    where = docs.columns.index(text)
    for index in _indexes(texts, items, size, bits, least_seeds, block_chars):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[[k for k, _ in _leaks(part.column(where), index.value, threshold)]] = False
                    yield part.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
