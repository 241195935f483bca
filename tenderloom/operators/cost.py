"""Projected cost of reading documents with a priced model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_rate(model: Column, rates: Mapping[str, float]) -> Column:
    """USD per million input tokens. An unlisted model is charged at the highest rate."""
    listed = F.create_map(*[F.lit(part) for entry in rates.items() for part in entry])
    return F.coalesce(F.try_element_at(listed, model), F.lit(float(max(rates.values()))))


def run_cost(documents: DataFrame, rates: Mapping[str, float]) -> DataFrame:
    """Documents, input tokens, USD and USD per document for each model in `documents`."""
    totals = documents.groupBy("model").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens")
    )
    usd = F.col("input_tokens") / F.lit(1_000_000) * input_rate(F.col("model"), rates)
    return totals.withColumn("usd", usd).withColumn(
        "usd_per_document", F.coalesce(F.try_divide("usd", "documents"), F.lit(0.0))
    )
