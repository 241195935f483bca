"""Counts, ids and files of tokens against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderloom.llm import bpe, token_counts, wavelet
from tenderloom.llm.shared import shared_folder

ALPHABET = list("aab Zé\n.,'s \t-<|> 　́ñ字1 9…×÷\r\x1c\x85  ̀ß\U0001f600  ") + [
    "<|endoftext|>",
    "'re",
    " the ",
    "aaaa",
    "----",
    "x" * 60,
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    mixed = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(60))) for _ in range(4000)]
    runs = [c * n for c in "a-= \n.0é" for n in (1, 2, 3, 7, 49, 50, 200)]
    every = [f"{chr(c)}a{chr(c)} {chr(c)}1" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    return ["", *mixed, *runs, *every]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_equal_the_library(texts):
    counts = token_counts.counter("byte_bpe_50k.json").counts(pa.array([*texts, None]))
    known = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert counts[1].tolist() == [*known, 0]
    assert counts[0].tolist() == [*(len(t.encode()) for t in texts), 0]


def test_a_full_table_of_pieces_starts_anew(texts):
    counter = token_counts.Counter("byte_bpe_50k.json")
    expected = counter.counts(pa.array(texts))[1].tolist()
    counter.table.most = 50
    assert counter.counts(pa.array(texts))[1].tolist() == expected


def test_ids_equal_tiktoken_and_decode_to_the_text(texts):
    name = "byte_bpe_multi_50k.tiktoken"
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={}
    )
    codec = bpe.codec(name)
    ids, edges = codec.encode(pa.array(texts))
    assert [part.tolist() for part in np.split(ids, edges[1:-1])] == [known.encode_ordinary(t) for t in texts]
    raw, where = codec.decode(ids, edges)
    assert [raw[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:])] == texts
    starts, ends = codec.spans(ids, edges)
    for k in range(0, len(texts), 97):
        owner = [n for n, c in enumerate(texts[k]) for _ in c.encode()]
        at = 0
        for token in range(edges[k], edges[k + 1]):
            length = codec.length[ids[token]]
            assert (starts[token], ends[token]) == (owner[at], owner[at + length - 1] + 1)
            at += length
    with pytest.raises(ValueError):
        codec.decode(np.array([-1]), np.array([0, 1]))


def test_operators_keep_rows_and_other_columns(odd_docs, no_docs):
    counted = token_counts.count_tokens(odd_docs)
    assert counted.schema["n_tokens"].dataType.simpleString() == "bigint" and counted.schema["score"]
    rows = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in counted.collect()}
    assert rows[(1, 0)] == rows[(2, 0)] == 0 and counted.count() == odd_docs.count()
    assert token_counts.count_tokens(no_docs).collect() == []
    coded = bpe.decode(bpe.encode(odd_docs, offsets=True, decoded="at_once"))
    assert coded.where("decoded <> at_once OR at_once IS NULL").count() == 0
    assert coded.where(F.decode("decoded", "utf-8") != F.coalesce("text", F.lit(""))).count() == 0
    assert coded.where("size(ids) <> size(char_starts) OR size(ids) <> size(char_ends)").count() == 0
    assert coded.count() == odd_docs.count() and "spans" in coded.columns
    assert bpe.decode(bpe.encode(no_docs)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 4000])
def test_matrix_reads_counts_and_finds(n):
    tokens = np.random.RandomState(n).zipf(1.3, n) % 40_000
    packed = wavelet.Shard(np.arange(1), np.array([n]), wavelet.WaveletMatrix.build(tokens)).pack()
    matrix = wavelet.Shard.unpack(packed).matrix
    assert (matrix.tokens() == tokens).all() and (matrix.access(np.arange(n)) == tokens).all()
    for token in [*tokens[:15].tolist(), 1, 39_999, 70_000]:
        assert matrix.count(token) == (tokens == token).sum()
        assert matrix.count(token, n // 3, n // 2) == (tokens[n // 3 : n // 2] == token).sum()
        assert (matrix.occurrences(token) == np.flatnonzero(tokens == token)).all()


def test_files_hold_all_documents_in_order(spark, odd_docs, no_docs):
    folder = shared_folder(spark, "test-wavelet")
    files = wavelet.write_shards(odd_docs, folder, shard_tokens=1000)
    back = wavelet.read_documents(spark, folder).join(files.select("shard", "base"), "shard").withColumn("start", F.expr("base + first"))
    rows = back.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    tokenizer, start = library("word_bpe_49k.json"), 0
    known = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    ids = {key: [*tokenizer.encode(key[1], add_special_tokens=False).ids, 1] for key in known}
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
        (key[0] or -1, len(ids[key]), crc(ids[key])) for key in known
    )
    assert [r["doc_id"] for r in rows] == sorted((k[0] for k in known), key=lambda v: -1 if v is None else v)
    for row in rows:
        assert row["start"] == start
        start += row["n_tokens"]
    wanted = ids[known[6]][:2]
    found = wavelet.find_tokens(spark, folder, wanted).collect()
    assert {(r["doc_id"], r["token"], r["place"]) for r in found} >= {(6, wanted[0], 0), (7, wanted[1], 1)}
    counted = {r["token"]: r["n"] for r in wavelet.count_tokens(spark, folder, wanted).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    assert counted == {t: sum(ids[key].count(t) for key in known) for t in wanted}
    empty = shared_folder(spark, "test-wavelet")
    assert wavelet.write_shards(no_docs, empty).collect() == []
    assert wavelet.read_documents(spark, empty).collect() == []


def test_rows_of_many_shards_lie_in_few_files(spark, monkeypatch):
    kept, write = [], wavelet.written
    monkeypatch.setattr(wavelet, "written", lambda *args: kept.append(write(*args)) or kept[-1])
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, key, f=type(spark.range(0)).repartitionByRange: f(self, 40, key))
    folder = shared_folder(spark, "test-wavelet")
    files = wavelet.write_shards(spark.range(400).selectExpr("id AS doc_id", "'one two' AS text"), folder)
    assert files.count() > 30 and files.agg(F.sum("n_docs")).first()[0] == 400
    assert len(kept[0].inputFiles()) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("scheme", ["s3", "s3a", "s3n"])
def test_shards_can_lie_in_s3(monkeypatch, scheme):
    asked = []
    monkeypatch.setattr(wavelet.pa.fs, "FileSystem", type("Named", (), {"from_uri": staticmethod(asked.append)}))
    wavelet.file_system(f"{scheme}://bucket/shared/llm")
    wavelet.file_system("file:///shared/llm")
    wavelet.file_system("/shared/llm")
    assert asked == ["s3://bucket/shared/llm", "file:///shared/llm", "/shared/llm"]
