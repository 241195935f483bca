"""Byte-level BPE ids from a table of ranks, and the way back from ids to bytes, text and character spans.

`encode` builds a tokenizer of the tokenizers library from a rank file: its vocabulary is written with the character
that stands for each byte, and every way to split a token into two others is a merge with that token's rank. Texts
come as Arrow batches; each different piece of text is encoded once for a Python worker. `decode` reverses the byte
table: ids become bytes, and bytes become text after joining, so a character split between tokens comes back whole.

Null and empty texts give no ids; no ids give empty bytes. A token that holds a part of a character spans that whole
character. Repeated texts are encoded alike; other columns are kept, and columns that have the name of a result are
replaced. Ids outside the vocabulary fail the job.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .arrow_text import list_array, ragged_positions, slices, small_batches, text_bytes, totals
from .pieces import PieceTable, library_encoder, piece_starts
from .token_counts import byte_characters


DECODED_IDS = 1 << 18  # ids decoded at a time, in whole rows


def read_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def build_tokenizer(ranks: dict[bytes, int]) -> Tokenizer:
    """A tokenizer that merges, in each match of the pattern, whatever two neighbours have the lowest joint rank."""
    shown = byte_characters()
    write = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:k], token[k:]) for k in range(1, len(token))]
        halves = [(a, b) for a, b in halves if a in ranks and b in ranks]
        merges += [(write(a), write(b)) for a, b in sorted(halves, key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))]
    model = models.BPE({write(token): rank for token, rank in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


class Codec:
    def __init__(self, name: str):
        self.name, ranks = name, read_ranks(name)
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[token] for token in tokens] != list(range(len(tokens))):
            raise ValueError(f"{name}: ranks are not 0, 1, 2, ...")
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @functools.cached_property
    def table(self) -> PieceTable:
        """Made on first use; workers that only decode do without."""
        return PieceTable(library_encoder(build_tokenizer(read_ranks(self.name))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin."""
        raw, edges = text_bytes(texts)
        starts = piece_starts(raw, edges)
        ids, count = self.table.tokens(raw, starts)
        return ids, np.concatenate([[0], np.cumsum(totals(count, np.searchsorted(starts, edges)))])

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where those of each row begin."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("an id is not in the vocabulary")
        length = self.length[ids]
        raw = self.bytes[ragged_positions(self.first[ids], length)]
        return raw, np.concatenate([[0], np.cumsum(length)])[edges]

    def spans(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, counted from the start of its row."""
        raw, where = self.decode(ids, edges)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        stop = np.cumsum(self.length[ids])
        start = stop - self.length[ids]
        row = np.repeat(begins[where[:-1]], np.diff(edges))
        inside = (raw[start] & 0xC0) == 0x80 if len(start) else np.empty(0, bool)
        return begins[start] - inside - row, begins[stop] - row


@functools.cache
def codec(name: str) -> Codec:
    """One for each Python worker."""
    return Codec(name)


def _binary(raw: np.ndarray, where: np.ndarray) -> pa.Array:
    parts = [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(raw)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(where) - 1, parts).cast(pa.binary())


def _mapped(docs: DataFrame, make, source: str, added: dict[str, str], drop: bool) -> DataFrame:
    """Runs make(batch, column index) -> new arrays over Arrow batches; other columns pass through."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == source or c not in added])
    kept = [f for f in docs.schema.fields if not (drop and f.name == source)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added.items()])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, arrays in make(batch):
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, *arrays], [*names, *added])

    return small_batches(docs).mapInArrow(run, schema)


def encode(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = "byte_bpe_multi_50k.tiktoken",
    offsets: bool = False,
    keep_text: bool = True,
    decoded: str | None = None,
) -> DataFrame:
    """Adds `ids` (array of int) and, with `offsets`, `char_starts` and `char_ends` of the tokens. With `decoded` a column
    of that name has the bytes that the ids decode to, as `decode` would give them but by the same Python worker: a
    check of the round trip then takes half the workers and their memory."""
    added = {"ids": "array<int>"} | ({"char_starts": "array<int>", "char_ends": "array<int>"} if offsets else {})
    if decoded:
        added[decoded] = "binary"

    def make(batch: pa.RecordBatch):
        coder = codec(vocabulary)
        for part in slices(batch, text):
            ids, edges = coder.encode(part.column(part.schema.get_field_index(text)))
            arrays = [ids] + (list(coder.spans(ids, edges)) if offsets else [])
            lists = [list_array(a.astype(np.int32), edges, pa.int32()) for a in arrays]
            yield part, [*lists, _binary(*coder.decode(ids, edges))] if decoded else lists

    return _mapped(docs, make, text, added, not keep_text)


def decode(
    rows: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken", into: str = "decoded"
) -> DataFrame:
    """Adds the bytes of each row's ids. `F.decode(into, 'utf-8')` is the text: characters split between tokens are
    whole again, and only bytes that form none are replaced."""

    def make(batch: pa.RecordBatch):
        coder = codec(vocabulary)
        column = batch.column(batch.schema.get_field_index(ids))
        every = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(every) // DECODED_IDS)) + 1
        for k, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            part, lengths = batch.slice(k, stop - k), every[k:stop]
            flat = column.slice(k, stop - k).flatten().to_numpy(zero_copy_only=False)
            yield part, [_binary(*coder.decode(flat, np.concatenate([[0], np.cumsum(lengths)])))]

    return _mapped(rows, make, ids, {into: "binary"}, False)
