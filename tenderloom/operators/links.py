"""Tender-to-award links per procedure, and what can be said about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.operators.touched import key_buckets, may_hold, rows_without
from tenderloom.schemas import AWARD, PROCEDURE_LINKS, RESOLVED_OUTCOMES, TENDER, UNKNOWN
from tenderloom.sources.tables import linkable


def procedure_facts(notices: DataFrame) -> DataFrame:
    """First tender and latest award of every procedure, in one pass and one shuffle.

    Outcome and result value are each taken from the latest award that states them, which may
    be an older one than the latest award. Notices without a date cannot be placed and are
    never picked. Equal dates are told apart by publication number.
    """
    is_tender, is_award = F.col("kind") == TENDER, F.col("kind") == AWARD
    dated = F.col("publication_date").isNotNull()
    place = ("publication_date", "publication_number")
    return (
        notices.where(F.col("procedure_id").isNotNull() & F.col("kind").isin(TENDER, AWARD))
        .groupBy("procedure_id")
        .agg(
            F.bool_or(is_tender).alias("has_tender"),
            F.min(F.when(is_tender & dated, F.struct(*place))).alias("tender"),
            F.max(F.when(is_award & dated, F.struct(*place))).alias("award"),
            F.max(
                F.when(is_award & dated & F.col("award_outcome").isNotNull(), F.struct(*place, "award_outcome"))
            ).alias("decided"),
            F.max(
                F.when(is_award & dated & F.col("result_value").isNotNull(), F.struct(*place, "result_value"))
            ).alias("valued"),
        )
    )


def link_procedures(notices: DataFrame) -> DataFrame:
    """One row per procedure with a tender: its award if any, the outcome and the lag in days.

    Equal to reducing tenders and awards apart and joining them to the left, without the join.
    No stated outcome means `unknown`, never `desierto`.
    """
    return _as_links(procedure_facts(notices).where("has_tender"))


def _as_links(facts: DataFrame) -> DataFrame:
    return facts.select(
        "procedure_id",
        F.col("tender.publication_number").alias("tender_pub"),
        F.col("tender.publication_date").alias("tender_date"),
        F.col("award.publication_number").alias("award_pub"),
        F.col("award.publication_date").alias("award_date"),
        F.coalesce("decided.award_outcome", F.lit(UNKNOWN)).alias("outcome"),
        F.col("valued.result_value").alias("result_value"),
        F.date_diff("award.publication_date", "tender.publication_date").cast("bigint").alias("lag_days"),
    ).select(*PROCEDURE_LINKS.names)


def touched_links(notices: DataFrame, touched: DataFrame) -> DataFrame:
    """The links of the procedures in `touched` (unique, not null). Notices of other procedures are dropped where they
    are read, before anything is shuffled; those that are left are combined by procedure before their shuffle."""
    near = may_hold(notices, key_buckets(touched, "procedure_id"), "procedure_id")
    return link_procedures(near).join(touched.select("procedure_id"), "procedure_id")


def relink(links: DataFrame, notices: DataFrame, touched: DataFrame) -> DataFrame:
    """`links` with the procedures in `touched` worked out again from `notices`.

    `touched` must also list the former procedure of a notice that moved to another one. A procedure that has lost its
    tender drops out. Only links and notices that share a hash bucket with a touched procedure are shuffled. `touched` is
    read several times and should be a stored table if it is dear to work out.
    """
    procedures = touched.select("procedure_id").where(F.col("procedure_id").isNotNull()).distinct()
    kept = rows_without(links, procedures, "procedure_id")
    redone = touched_links(notices, procedures)
    return kept.select(*PROCEDURE_LINKS.names).unionByName(redone)


def link_outcomes(links: DataFrame) -> DataFrame:
    """Number of links per outcome."""
    return links.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy("outcome")


def median_lag(links: DataFrame) -> DataFrame:
    """Exact median of the known lags, interpolated; NULL if there are none.

    Lags are counted first, so the final step sees one row per distinct number of days.
    """
    histogram = links.where(F.col("lag_days").isNotNull()).groupBy("lag_days").agg(F.count(F.lit(1)).alias("n"))
    return histogram.agg(F.percentile("lag_days", 0.5, F.col("n")).alias("median_lag_days"))


def resolved_outcomes(links: DataFrame) -> DataFrame:
    """Links whose outcome is known, oldest tender first."""
    return (
        links.where(F.col("outcome").isin(*RESOLVED_OUTCOMES))
        .select(
            "procedure_id",
            F.col("tender_pub").alias("tender_id"),
            "tender_date",
            F.col("outcome").alias("actual"),
            "result_value",
            "lag_days",
        )
        .orderBy(F.asc_nulls_last("tender_date"), "procedure_id")
    )


def award_procedures(notices: DataFrame) -> DataFrame:
    """Procedures that have an award notice."""
    return linkable(notices, AWARD).select("procedure_id").distinct()


def backfill_worklist(notices: DataFrame) -> DataFrame:
    """Procedures with an award but no tender yet, from one aggregation instead of an anti join."""
    return (
        notices.where(F.col("procedure_id").isNotNull() & F.col("kind").isin(TENDER, AWARD))
        .groupBy("procedure_id")
        .agg(F.bool_or(F.col("kind") == TENDER).alias("has_tender"))
        .where(~F.col("has_tender"))
        .select("procedure_id")
    )
