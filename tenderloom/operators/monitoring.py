"""Checks on an ingested notices table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.schemas import AWARD, NOTICE_KINDS, RESOLVED_OUTCOMES, TENDER, UNKNOWN


def ingest_watermarks(notices: DataFrame) -> DataFrame:
    """Latest publication date per kind, and the date to resume from: the earliest of them.

    Kinds without any date do not hold the resume date back.
    """
    latest = notices.agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("publication_date"))).alias(kind) for kind in (TENDER, AWARD)]
    )
    marks = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("watermark")) for kind in (TENDER, AWARD)])
    return latest.select(F.inline(marks), F.least(TENDER, AWARD).alias("resume_from")).select(
        "kind", "watermark", "resume_from"
    )


def eforms_coverage(notices: DataFrame) -> DataFrame:
    """Total, eForms notices and their fraction, over all kinds and for each; 0.0 when there are none."""
    wanted = {"all": F.lit(True)} | {kind: F.col("kind") == kind for kind in NOTICE_KINDS}
    counted = notices.agg(
        *[F.count_if(chosen).alias(f"total_{label}") for label, chosen in wanted.items()],
        *[F.count_if(chosen & F.col("is_eforms")).alias(f"eforms_{label}") for label, chosen in wanted.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("kind"),
                F.col(f"total_{label}").alias("total"),
                F.col(f"eforms_{label}").alias("eforms"),
                F.coalesce(F.try_divide(f"eforms_{label}", f"total_{label}"), F.lit(0.0)).alias("eforms_fraction"),
            )
            for label in wanted
        ]
    )
    return counted.select(F.inline(rows))


def _report(measure: str, label: Column, value: Column) -> Column:
    return F.struct(F.lit(measure).alias("measure"), label.alias("label"), value.cast("double").alias("value"))


def ingest_counts(batch: DataFrame, kinds: tuple[str, ...] = (AWARD, TENDER)) -> DataFrame:
    """Rows submitted per ingested kind, 0 for one without rows; repeats of a notice count each time."""
    counted = batch.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])
    return counted.select(
        F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n")) for kind in kinds]))
    )


def intake_counts(notices: DataFrame) -> DataFrame:
    """How many notices have a publication number and are kept, and how many are set aside, from one pass."""
    keyed = F.col("publication_number").isNotNull()
    counted = notices.agg(F.count_if(keyed).alias("kept"), F.count_if(~keyed).alias("set_aside"))
    rows = [F.struct(F.lit(state).alias("state"), F.col(state).alias("n")) for state in ("kept", "set_aside")]
    return counted.select(F.inline(F.array(*rows)))


def batch_metrics() -> list[Column]:
    """What an ingest run notes about the hits that it writes: rows and latest date of each kind, rows without a number."""
    keyed = F.col("publication_number").isNotNull()
    of_kind = {kind: keyed & (F.col("kind") == kind) for kind in (TENDER, AWARD)}
    return [
        *[F.count_if(chosen).alias(f"{kind}_rows") for kind, chosen in of_kind.items()],
        *[F.max(F.when(chosen, F.col("publication_date"))).alias(f"{kind}_latest") for kind, chosen in of_kind.items()],
        F.count_if(~keyed).alias("unkeyed"),
    ]


def metrics_report(spark: SparkSession, metrics: dict[str, object]) -> DataFrame:
    """The part of the run report that follows from the metrics of `batch_metrics`."""
    rows = [("ingested", kind, float(metrics[f"{kind}_rows"])) for kind in (AWARD, TENDER)]
    return spark.createDataFrame(rows, "measure string, label string, value double")


def dataset_report(batch: DataFrame, links: DataFrame) -> DataFrame:
    """What an ingest run did: rows per kind, links, links per outcome, median lag."""
    ingested = ingest_counts(batch).select(
        F.lit("ingested").alias("measure"), F.col("kind").alias("label"), F.col("n").cast("double").alias("value")
    )
    return ingested.unionByName(links_report(links))


def links_report(links: DataFrame) -> DataFrame:
    """Links, links per outcome, and the median lag. The links are read once: all of it follows from their number per
    outcome and lag."""
    histogram = links.groupBy("outcome", "lag_days").agg(F.count(F.lit(1)).alias("n"))
    outcomes = (*RESOLVED_OUTCOMES, UNKNOWN)
    totals = histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linked"),
        *[F.sum(F.when(F.col("outcome") == outcome, F.col("n"))).alias(outcome) for outcome in outcomes],
        F.percentile(F.col("lag_days"), F.lit(0.5), F.when(F.col("lag_days").isNull(), 0).otherwise(F.col("n"))).alias("lag"),
    )
    rows = [
        _report("linked", F.lit("all"), F.col("linked")),
        *[_report("outcome", F.lit(outcome), F.col(outcome)) for outcome in outcomes],
        _report("median_lag_days", F.lit("all"), F.col("lag")),
    ]
    listed = totals.select(F.inline(F.array(*rows)))
    return listed.where("measure <> 'outcome' OR value IS NOT NULL")


def lag_sketches(links: DataFrame, k: int = 200) -> DataFrame:
    """A quantile sketch of the lags of each award day: award_date and lags, a few kilobytes whatever the number of links.

    Sketches of days merge into one of any window (`approximate_median_lag`), so a dashboard need not read the links
    again. `k` sets size and error: a quantile's rank is off by about 1.3 percent at 200.
    """
    known = links.where(F.col("lag_days").isNotNull())
    return known.groupBy("award_date").agg(F.kll_sketch_agg_bigint("lag_days", k).alias("lags"))


def approximate_median_lag(
    sketches: DataFrame, date_from: dt.date | str | None = None, date_to: dt.date | str | None = None
) -> DataFrame:
    """Number of lags and their median, to the error of the sketches, over award days in a window (both ends included).
    The exact median is `links.median_lag`. NULL if there are none."""
    chosen = sketches
    if date_from is not None:
        chosen = chosen.where(F.col("award_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        chosen = chosen.where(F.col("award_date") <= F.lit(date_to).cast("date"))
    merged = chosen.agg(F.count(F.lit(1)).alias("days"), F.kll_merge_agg_bigint("lags").alias("lags"))
    some = F.col("days") > 0
    return merged.select(
        F.when(some, F.kll_sketch_get_n_bigint("lags")).otherwise(F.lit(0)).cast("bigint").alias("n"),
        F.when(some, F.kll_sketch_get_quantile_bigint("lags", F.lit(0.5))).alias("median_lag_days"),
    )
