"""The registered queries: against SQL where there is some, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from compare import compare
from test_matching import ITEMS, plain_classes
from tokenizers import Tokenizer

from tenderloom.llm import bpe, decontaminate, oracle, queries, secret_scan

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sample, name):
    good, detail = compare(spark, sample, name, queries.queries()[name], SQL[name])
    assert good, detail


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_gives_a_row_for_each_document(spark, sample, name):
    if name in ("op5_decontaminate", "op12_whitening"):
        pytest.skip("its rows are others; see its own tests")
    ids = [r["doc_id"] for r in queries.queries()[name](spark, sample).select("doc_id").collect()]
    assert sorted(ids) == list(range(200))


def _texts(spark, sample):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}


def _library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_files_equal_the_library(spark, sample):
    texts, at = _texts(spark, sample), 0
    found = {r["doc_id"]: r for r in queries.op4_wavelet_matrix(spark, sample).collect()}
    coder = _library("word_bpe_49k.json")
    for i in sorted(texts):
        ids = [*coder.encode(texts[i], add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(found[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (at, len(ids), zlib.crc32(raw))
        at += len(ids)


def test_classes_equal_all_pairs(spark, sample):
    expected = plain_classes(sorted(_texts(spark, sample).items()))
    found = queries.op6_jaccard_join(spark, sample).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == expected


def test_leaks_equal_alignments_of_all_documents_and_items(spark, sample):
    texts = _texts(spark, sample)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()}
    expected = {}
    for item, item_text in items.items():
        vocabulary = decontaminate.Vocabulary([item_text or ""])
        size = len(vocabulary.words)
        for doc, text in texts.items():
            numbers = vocabulary.numbers(pa.array([text], pa.string()))[0]
            if size and len(numbers):
                best = float(np.max(decontaminate.align(vocabulary.words, numbers[None, :])[0]))
                if best >= size:
                    expected[doc, item] = best / (2 * size)
    found = queries.op5_decontaminate(spark, sample).collect()
    assert expected and {(r["doc_id"], r["item_id"]): r["score"] for r in found} == pytest.approx(expected)


def test_byte_bpe_equals_the_library(spark, sample):
    name = "byte_bpe_multi_50k.tiktoken"
    coder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={}
    )
    texts = _texts(spark, sample)
    for r in queries.op7_byte_bpe(spark, sample).collect():
        ids, raw = coder.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]].encode()
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_token_counts_equal_the_library(spark, sample):
    texts, coder = _texts(spark, sample), _library("byte_bpe_50k.json")
    for r in queries.op9_token_counts(spark, sample).collect():
        n = len(coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


SECRETS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def test_base_secrets_equal_the_stated_patterns(spark, sample):
    texts = _texts(spark, sample)
    for r in queries.op10_secret_scan(spark, sample).collect():
        spans = []
        for rank, (kind, pattern) in enumerate(SECRETS.items()):
            for m in re.finditer(pattern, texts[r["doc_id"]]):
                if len(m[2 if kind == "assign" else 0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        base = [shown for _, _, shown in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in SECRETS] == [sum(b.startswith(f"{k}:") for b in base) for k in SECRETS]


def test_pipeline_equals_plain_stages(spark, sample):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    good = {r["doc_id"] for r in queries.op8_quality_rules(spark, sample).where("kept").collect()}
    classes = plain_classes([(i, docs[i]) for i in sorted(good)])
    kept = {i for i in good if classes[i][0] == i}
    items = [r["text"].lower() for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(item in docs[i].lower() for item in items)}
    name = "byte_bpe_multi_50k.tiktoken"
    coder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={}
    )
    rows = corpus_pipeline.run(spark, sample).collect()
    assert {r["doc_id"] for r in rows} == clean and len(rows) == len(clean)
    for row in rows:
        text = secret_scan.redacted(docs[row["doc_id"]], secret_scan.scan(docs[row["doc_id"]])[1])
        assert row["ids"] == coder.encode_ordinary(text)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_stand_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, f"file://{tmp_path}")
            assert after.columns == docs.columns and after.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == docs.count()


def test_quality_stage_measures_once(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    stage = corpus_pipeline.quality_rules(spark, docs, sample)._jdf.queryExecution().optimizedPlan().toString()
    alone = queries.op8_quality_rules(spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    assert stage.count("split(") == alone.count("split(") and stage.count("xxhash64(") == alone.count("xxhash64(")
