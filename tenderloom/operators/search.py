"""Tender search, lookups and award history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.operators.tenders import legal_documents, notice_key
from tenderloom.schemas import AWARD


def in_family(prefix: str | None) -> Column:
    """Product codes that start with `prefix`, taken literally; no prefix means any tender."""
    return F.col("cpv_primary").startswith(prefix) if prefix else F.lit(True)


def _summary_columns() -> list[Column]:
    return [
        F.col("entry_id").alias("tender_id"),
        F.col("expediente"),
        F.col("title"),
        F.col("budget").alias("budget_eur"),
        F.col("cpv_primary").alias("cpv"),
        F.date_format("deadline", "yyyy-MM-dd").alias("deadline"),
        F.size("documents").cast("bigint").alias("documents"),
    ]


def tender_summary(tenders: DataFrame) -> DataFrame:
    """The columns shown for a tender."""
    return tenders.select(*_summary_columns())


def search_tenders(
    tenders: DataFrame,
    cpv_prefix: str | None = None,
    max_budget: float | None = None,
    min_budget: float | None = None,
    limit: int = 20,
) -> DataFrame:
    """Largest budgets first, unknown budgets last; bounds include their value.

    A tender without a budget meets no bound. Zero is a bound like any other. Tenders after the first
    `limit` are left out.
    """
    found = tenders.where(in_family(cpv_prefix))
    if max_budget is not None:
        found = found.where(F.col("budget") <= max_budget)
    if min_budget is not None:
        found = found.where(F.col("budget") >= min_budget)
    return tender_summary(found.orderBy(F.desc_nulls_last("budget"), "entry_id").limit(limit))


def tender_details(tenders: DataFrame) -> DataFrame:
    """Summary of each tender together with its document links."""
    return tenders.select(*_summary_columns(), F.col("documents").alias("document_links"))


def get_tender(tenders: DataFrame, tender_id: str) -> DataFrame:
    """Details of one tender: one row, or none if there is no such tender."""
    return tender_details(tenders.where(F.col("entry_id") == tender_id))


def get_tenders(tenders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Details of the tenders listed in `wanted.tender_id`."""
    keys = wanted.select(F.col("tender_id").alias("entry_id")).distinct()
    return tender_details(tenders.join(keys, "entry_id", "left_semi"))


def document_links(tenders: DataFrame) -> DataFrame:
    """One row per document link."""
    return tenders.select(F.col("entry_id").alias("tender_id"), F.inline("documents"))


def document_coverage(tenders: DataFrame) -> DataFrame:
    """Number of tenders, and of those with at least one document."""
    return tenders.agg(
        F.count(F.lit(1)).alias("tenders"), F.count_if(F.size("documents") > 0).alias("with_documents")
    )


def gradable_tenders(tenders: DataFrame) -> DataFrame:
    """Tenders with a published value to grade against and a legal document to read it from.

    The first legal document is the one to read. The key is the one tenders have as notices.
    """
    first_legal = F.get(legal_documents(F.col("documents")), F.lit(0))
    has_truth = F.coalesce(
        F.col("budget").cast("string"), F.col("cpv_primary"), F.col("deadline").cast("string")
    ).isNotNull()
    return tenders.where(has_truth & first_legal.isNotNull()).select(
        notice_key().alias("tender_id"),
        first_legal["uri"].alias("document_uri"),
        F.col("budget").alias("estimated_value"),
        "cpv_primary",
        "deadline",
    )


def past_awards(notices: DataFrame, cpv_prefix: str, limit: int = 10) -> DataFrame:
    """The `limit` largest awards of a product family, those without a stated value last."""
    return (
        notices.where((F.col("kind") == AWARD) & F.col("cpv_primary").startswith(cpv_prefix))
        .orderBy(F.desc_nulls_last("result_value"), "publication_number")
        .limit(limit)
        .select(
            F.col("publication_number").alias("notice"),
            "title",
            F.col("result_value").alias("award_value_eur"),
            F.coalesce("winner_names", F.array().cast("array<string>")).alias("winners"),
            F.col("award_outcome").alias("outcome"),
        )
    )


def award_outcome_counts(notices: DataFrame, cpv_prefix: str) -> DataFrame:
    """Awards of a product family per stated outcome; awards without one are not counted."""
    stated = (F.col("kind") == AWARD) & F.col("award_outcome").isNotNull()
    return (
        notices.where(stated & F.col("cpv_primary").startswith(cpv_prefix))
        .groupBy(F.col("award_outcome").alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
