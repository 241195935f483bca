"""Token counts of whole texts by byte-pair merging on ragged arrays, all sequences of a batch at once.

Every different pre-token of a batch is a row of a ragged array of symbols. In each round every row finds its own
lowest-ranked pair and merges all its occurrences from the left; rows without a known pair are done and give the
number of symbols they have left. A pair's merged symbol has no rank below the pair's own, so merging all occurrences
in one round gives what merging them one by one gives.

Null and empty texts have 0 tokens. Repeated texts are counted each; other columns are kept, and a column that has
the name of a result is replaced.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, small_batches, text_bytes, totals
from .pieces import PieceTable, piece_starts

NONE = np.int32(np.iinfo(np.int32).max)


class PairRanks:
    """Merge ranks of pairs of symbols, found for whole arrays of pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, symbols: int):
        self.symbols = np.int64(symbols)
        keys = left.astype(np.int64) * self.symbols + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.merged = merged.astype(np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)


def symbols_left(symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """How many symbols each sequence has after all merges. `lengths` are at least 1."""
    left = lengths.copy()
    rows = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[keep], lengths[rows]
    if not len(rows):
        return left

    def pair_ranks(at: np.ndarray, last: np.ndarray) -> np.ndarray:
        found = np.full(len(at), NONE, np.int32)
        inner = ~last[at]
        found[inner] = ranks.of(symbols[at[inner]], symbols[at[inner] + 1])
        return found

    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths) - 1] = True
    rank = pair_ranks(np.arange(len(symbols)), last)
    while len(rows):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(rank, starts)
        open_rows = lowest < NONE
        if not open_rows.all():
            left[rows[~open_rows]] = lengths[~open_rows]
            stay = np.repeat(open_rows, lengths)
            symbols, rank, last = symbols[stay], rank[stay], last[stay]
            rows, lengths, lowest = rows[open_rows], lengths[open_rows], lowest[open_rows]
            if not len(rows):
                break
        hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # Overlapping occurrences (a a a): in a run of neighbours every second one counts, from the left.
        begins = np.concatenate([[True], np.diff(hits) > 1])
        run_start = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
        symbols[hits] = ranks.merged[rank[hits]]
        last[hits] = last[hits + 1]
        stay = np.ones(len(symbols), bool)
        stay[hits + 1] = False
        lengths -= np.bincount(np.searchsorted(np.cumsum(lengths), hits, "right"), minlength=len(rows))
        at = np.cumsum(stay)[hits] - 1
        symbols, rank, last = symbols[stay], rank[stay], last[stay]
        before = at - 1
        touched = np.concatenate([at, before[(before >= 0) & ~last[before]]])
        rank[touched] = pair_ranks(touched, last)
    return left


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level vocabulary file (.json)."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            held = json.load(file)
        vocab = held["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        number = lambda part: np.array([vocab[p[part]] for p in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = PairRanks(number(0), number(1), merged, max(vocab.values()) + 1)
        self.of_byte = np.array([vocab[character] for character in byte_characters()], np.int32)
        special = [regex.escape(t["content"]) for t in held["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.table = PieceTable(self.encode)

    def _words(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in a piece, and the pre-tokens of the rest."""
        if self.special is None or "<" not in text:
            return 0, self.split.findall(text)
        rest = self.special.split(text)
        return len(rest) - 1, [word for part in rest for word in self.split.findall(part)]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """No ids, but for each piece one value: its number of tokens."""
        count = np.zeros(len(pieces), np.int64)
        words, owner = [], []
        for k, piece in enumerate(pieces):
            special, found = self._words(piece.decode())
            count[k] = special
            words += found
            owner += [k] * len(found)
        if words:
            joined = [word.encode() for word in words]
            lengths = np.fromiter(map(len, joined), np.int64, len(joined))
            symbols = self.of_byte[np.frombuffer(b"".join(joined), np.uint8)]
            count += np.bincount(owner, symbols_left(symbols, lengths, self.ranks), len(pieces)).astype(np.int64)
        return count, np.ones(len(pieces), np.int64)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        raw, edges = text_bytes(texts)
        starts = piece_starts(raw, edges, b"<|" if self.special else None)
        each, _ = self.table.tokens(raw, starts)
        return np.diff(edges), totals(each, np.searchsorted(starts, edges))


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the
    others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@functools.cache
def counter(name: str) -> Counter:
    """One for each Python worker, whose table of pieces serves all its tasks."""
    return Counter(name)


def count_tokens(
    docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024
) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) to each row."""
    added = ["n_bytes", "n_tokens"]
    others = [c for c in docs.columns if c not in (*added, "over_limit")]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema if f.name != text]
        + [f"{name} long" for name in added]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                n_bytes, n_tokens = count.counts(part.column(part.schema.get_field_index(text)))
                kept = part.select([c for c in part.schema.names if c != text])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(n_bytes), pa.array(n_tokens)], [*kept.schema.names, *added]
                )

    counted = small_batches(docs).select(*[F.col(f"`{c}`") for c in others]).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
