"""One query for each operator over its whole table, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, disclosure, filter_audit, jaccard, quality, revisits, secret_scan, token_counts
from . import toxicity, wavelet, whitening
from .shared import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Formats all conversations, and one whose texts are control strings, and reads the strings back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens_attached",
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from documents outside the held-out third."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages as archive records: each page is fetched once in full and asked for again three times, once
    before that; some answers lack validators and some contradict the response."""
    begin = F.lit(1704067200) + F.col("page_id") * 7919 % 31536000
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    etag = F.when(F.col("page_id") % 7 != 3, F.concat(F.lit('"'), "digest", F.lit('"')))
    page = pages.select("page_id", "url", digest.alias("digest"), F.length("html").alias("n"), begin.alias("begin"))
    page = page.withColumn("etag", etag).withColumn("changed", F.when(F.col("page_id") % 5 != 2, F.col("begin") - 3600))
    visit = page.withColumn("visit", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    kth = F.col("visit")
    time = F.col("begin") + F.when(kth == 3, -86400).otherwise(kth * 86400)
    weak = F.when((kth == 1) & (F.col("page_id") % 3 == 0), F.concat(F.lit("W/"), "etag")).otherwise(F.col("etag"))
    other = (kth == 2) & (F.col("page_id") % 4 == 0)
    full = F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.col("n")),
                   header("Date", time), header("Cache-Control", F.lit("max-age=60")))
    not_modified = F.array(header("Date", time), header("cache-control", F.lit("max-age=120")),
                           header("Content-Length", F.lit(0)), header("Server", F.lit("edge")))
    return visit.select(
        (F.col("page_id") * 4 + kth).alias("record_id"),
        "url",
        time.alias("time"),
        F.when(kth == 0, "response").otherwise("revisit").alias("kind"),
        F.when(other & F.col("etag").isNotNull(), F.lit('"other"')).otherwise(weak).alias("etag"),
        F.when(other, F.col("changed") + 1).otherwise(F.col("changed")).alias("last_modified"),
        F.when(kth == 0, full).otherwise(not_modified).alias("headers"),
        F.when(kth == 0, F.col("digest")).alias("digest"),
    )


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every not-modified answer of a crawl of all pages, resolved."""
    found = revisits.resolve_revisits(captures(table(spark, folder, "pages")))
    shown = F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))
    return found.withColumn("headers", F.array_join(F.array_sort(shown), "; "))


def op4_wavelet_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the ids of all documents into wavelet-matrix files and reads them back document by document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    shards = shared_folder(spark, "wavelet")
    files = wavelet.write_shards(docs, shards)
    read = wavelet.read_documents(spark, shards)
    return read.join(files.select("shard", "base"), "shard").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold test items, exact or edited, with the alignment score."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document, and its number of links."""
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document as a digest, and a digest of the bytes they decode to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, keep_text=False, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    scored = quality.score_quality(table(spark, folder, "documents").select("doc_id", "text"))
    return scored.select("doc_id", *quality.MEASURES, "broken_rules", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document, and whether it is over 1,024."""
    return token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, in the text as it is and in what it holds encoded."""
    found = secret_scan.find_secrets(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents, step by step in every order, for each language."""
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding along the four strongest components, whitened by the covariance of the different vectors."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, and the words that would give it away."""
    found = disclosure.sanitise(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [f"n_{kind}" for kind in (*disclosure.KINDS, "generalised", "removed")]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_toxicity": op2_toxicity,
        "op3_warc_revisits": op3_warc_revisits,
        "op4_wavelet_matrix": op4_wavelet_matrix,
        "op5_decontaminate": op5_decontaminate,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_secret_scan": op10_secret_scan,
        "op11_filter_audit": op11_filter_audit,
        "op12_whitening": op12_whitening,
        "op13_disclosure": op13_disclosure,
    }
