"""Predicted outcomes scored against what happened, next to always guessing the majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.schemas import RESOLVED_OUTCOMES


def pair_predictions(predictions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Predictions of resolved tenders with the actual outcome and the number of equal ones (`n`).

    Predictions are counted per tender and label before the join, so repeats of one tender
    never meet it row by row.
    """
    counted = predictions.groupBy("tender_id", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(resolved.select("tender_id", "actual"), "tender_id")


def majority_baseline(pairs: DataFrame) -> DataFrame:
    """The most common actual outcome and its share; no row for an empty input."""
    by_label = pairs.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("n"))
    # One row per outcome is left here. Equal counts go to the label that sorts first.
    top = F.min(F.struct((-F.col("n")).alias("minus_n"), "label"))
    return (
        by_label.agg(top.alias("top"), F.sum("n").alias("total"))
        .where(F.col("top").isNotNull())
        .select("top.label", F.try_divide(-F.col("top.minus_n"), F.col("total")).alias("accuracy"))
    )


def _counters(pairs: DataFrame) -> DataFrame:
    """All sums that both reports need, from one aggregation without grouping."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    predicted, actual = F.col("predicted"), F.col("actual")
    per_class = [
        column
        for label in RESOLVED_OUTCOMES
        for column in (
            total(actual == label).alias(f"support_{label}"),
            total(predicted == label).alias(f"predicted_{label}"),
            total((predicted == label) & (actual == label)).alias(f"hits_{label}"),
        )
    ]
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total(predicted == actual).alias("correct"), *per_class
    )


def backtest_summary(pairs: DataFrame) -> DataFrame:
    """One row: size, accuracy, majority baseline, lift over it, and whether it is beaten.

    Without any resolved prediction the size is 0 and the rest NULL, with `beats_baseline` false.
    """
    first, second = RESOLVED_OUTCOMES
    label = F.when(
        F.col("n") > 0, F.when(F.col(f"support_{first}") >= F.col(f"support_{second}"), first).otherwise(second)
    )
    return (
        _counters(pairs)
        .select(
            "n",
            F.try_divide("correct", "n").alias("accuracy"),
            label.alias("baseline_label"),
            F.try_divide(F.greatest(f"support_{first}", f"support_{second}"), F.col("n")).alias("baseline_accuracy"),
        )
        .withColumn("lift", F.col("accuracy") - F.col("baseline_accuracy"))
        .withColumn("beats_baseline", F.coalesce(F.col("lift") > 0, F.lit(False)))
    )


def backtest_per_class(pairs: DataFrame) -> DataFrame:
    """Support, predicted, true positives, precision, recall and F1 per outcome.

    A class never predicted has no precision, one never seen no recall, and F1 needs both and
    a sum above zero. Both classes are listed unless nothing was graded.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.col(f"support_{label}").alias("support"),
                F.col(f"predicted_{label}").alias("predicted"),
                F.col(f"hits_{label}").alias("true_positives"),
                F.try_divide(f"hits_{label}", f"predicted_{label}").alias("precision"),
                F.try_divide(f"hits_{label}", f"support_{label}").alias("recall"),
            )
            for label in RESOLVED_OUTCOMES
        ]
    )
    both = F.col("precision") + F.col("recall")
    return (
        _counters(pairs)
        .where(F.col("n") > 0)
        .select(F.inline(rows))
        .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), both))
    )
