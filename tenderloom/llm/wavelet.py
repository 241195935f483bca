"""Token ids in wavelet-matrix files, one for each shard of whole documents.

A matrix holds one bit of every token in each plane, from the highest bit down; below each plane the tokens are
stably parted by its bit. With counts of set bits by block, a token is read, counted or found in as many steps as
an id has bits, without unpacking the shard. Planes are packed bits, and every part of a file is zstandard-compressed.

File, little-endian: the magic bytes, a 32-bit length, that many bytes of JSON (tokens, bits, zeros of each plane, parts
with name, place and size), then the parts: doc_ids and doc_ends (64-bit), and for each plane its bits and block counts.

Null and empty texts have just the end token. Rows without a document id come first; rows with the same id stay
separate documents, in no set order among themselves. Other columns are not stored. An empty table gives no file.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrow_text import slices, small_batches, text_bytes, totals
from .pieces import PieceTable, joined_encoder, piece_starts
from .shared import written

MAGIC = b"WAVEMAT1"
WORDS = 8  # 64-bit words in a block that has its own count
NO_ID = np.iinfo(np.int64).min


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], blocks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.blocks = n, bits, planes, zeros, blocks

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        n = len(tokens)
        bits = max(1, int(tokens.max()).bit_length()) if n else 1
        rows = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, blocks = [], [], []
        for level in range(bits):
            ones = (rows & rows.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.zeros(-(-n // (64 * WORDS)) * WORDS * 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(ones, bitorder="little")
            words = packed.view(np.uint64)
            counts = np.bitwise_count(words).reshape(-1, WORDS).sum(1, dtype=np.int64)
            planes.append(words)
            blocks.append(np.concatenate([[0], np.cumsum(counts)]))
            zeros.append(n - int(blocks[-1][-1]))
            # Places are found without a branch for each bit, which beats a mask here.
            below = np.empty_like(rows)
            below[: zeros[-1]] = rows.take(np.flatnonzero(~ones))
            below[zeros[-1] :] = rows.take(np.flatnonzero(ones))
            rows = below
        return cls(n, bits, planes, zeros, blocks)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each place."""
        words, word = self.planes[level], at >> 6
        block = word // WORDS
        found = self.blocks[level][block].copy()
        for k in range(WORDS):
            one = block * WORDS + k
            full = one < word
            found[full] += np.bitwise_count(words[one[full]])
        part = at & 63
        inner = part > 0
        below = (np.uint64(1) << part[inner].astype(np.uint64)) - np.uint64(1)
        found[inner] += np.bitwise_count(words[word[inner]] & below)
        return found

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at some places."""
        at, found = np.asarray(at, np.int64).copy(), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one, ones = self._bit(level, at), self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            found = found << 1 | one
        return found

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        edge = np.array([begin, end], np.int64)
        for level in range(self.bits):
            ones = self._ones(level, edge)
            edge = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs from `begin` up to `end`."""
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the bits of one kind that have so many of that kind before them."""
        ones = self.blocks[level]
        before = ones if bit else np.arange(len(ones)) * 64 * WORDS - ones
        block = np.searchsorted(before, which, "right") - 1
        rest = which - before[block]
        found = np.zeros(len(which), np.int64)
        pending = np.ones(len(which), bool)
        for k in range(WORDS):
            word = block * WORDS + k
            words = self.planes[level][np.minimum(word, len(self.planes[level]) - 1)]
            words = words if bit else ~words
            many = np.bitwise_count(words).astype(np.int64)
            here = pending & (rest < many)
            if here.any():
                shown = np.unpackbits(words[here].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                found[here] = word[here] * 64 + (np.cumsum(shown, axis=1) > rest[here, None]).argmax(axis=1)
            pending &= ~here
            rest = np.where(pending, rest - many, rest)
        return found

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, put together from the lowest plane up."""
        rows = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(rows)
            above[np.flatnonzero(~ones)] = rows[: self.zeros[level]]
            above[np.flatnonzero(ones)] = rows[self.zeros[level] :] | rows.dtype.type(1 << (self.bits - 1 - level))
            rows = above
        return rows


class Shard:
    """A matrix with the documents whose tokens it holds: their ids, and where each one's tokens end."""

    def __init__(self, doc_ids: np.ndarray, doc_ends: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.doc_ends, self.matrix = doc_ids, doc_ends, matrix

    def pack(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = {"doc_ids": self.doc_ids.astype("<i8"), "doc_ends": self.doc_ends.astype("<i8")}
        for level in range(self.matrix.bits):
            parts[f"plane{level}"] = self.matrix.planes[level].astype("<u8")
            parts[f"block{level}"] = self.matrix.blocks[level].astype("<u4")
        body, held = [], []
        for name, values in parts.items():
            body.append(squeeze(values.tobytes()))
            held.append([name, sum(map(len, body)) - len(body[-1]), len(body[-1])])
        head = json.dumps(
            {"tokens": self.matrix.n, "bits": self.matrix.bits, "zeros": self.matrix.zeros, "parts": held}
        ).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (length,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + length])
        view, loose = memoryview(data)[12 + length :], zstandard.ZstdDecompressor().decompress
        part = {name: loose(view[at : at + size]) for name, at, size in head["parts"]}
        levels = range(head["bits"])
        matrix = WaveletMatrix(
            head["tokens"],
            head["bits"],
            [np.frombuffer(part[f"plane{k}"], "<u8") for k in levels],
            head["zeros"],
            [np.frombuffer(part[f"block{k}"], "<u4").astype(np.int64) for k in levels],
        )
        return cls(np.frombuffer(part["doc_ids"], "<i8"), np.frombuffer(part["doc_ends"], "<i8"), matrix)


class Encoder:
    def __init__(self, name: str):
        # Spark keeps all cores busy with tasks; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.table = PieceTable(joined_encoder(Tokenizer.from_file(public_tokenizers.path(name)), b"<"), 2_000_000)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        raw, edges = text_bytes(texts)
        starts = piece_starts(raw, edges, b"<|")
        ids, count = self.table.tokens(raw, starts)
        each = totals(count, np.searchsorted(starts, edges))
        return np.insert(ids, np.cumsum(each), end_id), each + 1


@functools.cache
def encoder(name: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(name)


def file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a folder, and the folder's path in it. Hadoop's names of S3 are other than Arrow's."""
    scheme, colon, rest = folder.partition("://")
    return pa.fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else folder)


def write_shards(
    docs: DataFrame,
    folder: str,
    text: str = "text",
    key: str = "doc_id",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    shard_tokens: int = 1 << 22,
) -> DataFrame:
    """Writes the ids of all documents into files below `folder`, in ascending order of `key`, and returns a row for
    each file: shard, n_docs, n_tokens and base (tokens in all files before it). A file holds whole documents and is
    closed once it has `shard_tokens`. Files get their names when complete, so a repeated task replaces its own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        code, task, made = encoder(vocabulary), TaskContext.get(), 0
        keys, ids, counts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, counts, held, made
            doc_ids, ends = np.concatenate(keys), np.cumsum(np.concatenate(counts))
            name = f"shard-{task.partitionId():07d}-{made:05d}"
            data = Shard(doc_ids, ends, WaveletMatrix.build(np.concatenate(ids))).pack()
            attempt = f"{root}/.{name}-{task.taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                out.write(data)
            store.move(attempt, f"{root}/{name}.wm")
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            keys, ids, counts, held, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for part in slices(batch, "text"):
                found, each = code.encode(part.column(1), end_id)
                keys.append(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                ids.append(found)
                counts.append(each)
                held += len(found)
                if held >= shard_tokens:
                    yield close()
        if keys:
            yield close()

    store, root = file_system(folder)
    store.create_dir(root, recursive=True)  # there without documents too
    rows = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    files = ordered.mapInArrow(build, "shard string, n_docs long, n_tokens long")
    # A row or two from each task. Spark's writer of a local file starts a process for its rights, a copy of the executor
    # to all who look at its memory, so the rows go to a few files and not to one from each task.
    files = written(files.repartition(docs.sparkSession.sparkContext.defaultParallelism), "shards")
    # One row for each file, in the order of their names.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    """Runs make(name, Shard) -> RecordBatch over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1].removesuffix(".wm")
                yield make(name, Shard.unpack(content.as_buffer().to_pybytes()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def _ids(keys: np.ndarray) -> pa.Array:
    return pa.array(keys, mask=keys == NO_ID)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document: shard, doc_id, its first place in the shard, n_tokens, and crc32 of its ids as
    little-endian 32-bit numbers."""

    def make(name: str, shard: Shard) -> pa.RecordBatch:
        raw = memoryview(shard.matrix.tokens().astype("<u4")).cast("B")
        ends = shard.doc_ends
        first = np.concatenate([[0], ends[:-1]])
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
        columns = [pa.array([name] * len(ends)), _ids(shard.doc_ids), pa.array(first), pa.array(ends - first)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(crc, pa.int64())], ["shard", "doc_id", "first", "n_tokens", "ids_crc32"]
        )

    return _read(spark, folder, make, "shard string, doc_id long, first long, n_tokens long, ids_crc32 long")


def find_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """Where given tokens occur: shard, token, doc_id and the place in the document, from the planes alone."""

    def make(name: str, shard: Shard) -> pa.RecordBatch:
        found = [shard.matrix.occurrences(token) for token in tokens]
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        doc = np.searchsorted(shard.doc_ends, at, "right")
        first = np.concatenate([[0], shard.doc_ends])[doc]
        token = np.repeat(np.asarray(tokens, np.int64), [len(f) for f in found])
        arrays = [pa.array([name] * len(at), pa.string()), pa.array(token), _ids(shard.doc_ids[doc]), pa.array(at - first)]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "token", "doc_id", "place"])

    return _read(spark, folder, make, "shard string, token long, doc_id long, place long")


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """How often given tokens occur in each shard, by counting alone."""

    def make(name: str, shard: Shard) -> pa.RecordBatch:
        counts = [shard.matrix.count(token) for token in tokens]
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([name] * len(tokens), pa.string()), "token": pa.array(tokens, pa.int64()), "n": pa.array(counts, pa.int64())}
        )

    return _read(spark, folder, make, "shard string, token long, n long")
