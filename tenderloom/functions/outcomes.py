"""Classification of notices and of award results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.schemas import AWARD, AWARDED, DESIERTO, LOT_AWARDED, LOT_CLOSED, OTHER, TENDER


def notice_kind(notice_type: Column) -> Column:
    """`can…` is an award and is tested first, any other `cn…` a tender."""
    return (
        F.when(notice_type.startswith("can"), AWARD)
        .when(notice_type.startswith("cn"), TENDER)
        .otherwise(OTHER)
    )


def award_outcome(kind: Column, lot_statuses: Column) -> Column:
    """Result of an award notice from its lot statuses; NULL when not an award or not published.

    One selected winner makes it awarded. It is desierto only if every lot closed without a
    winner. Any other published status counts as awarded.
    """
    selected = F.array_contains(lot_statuses, LOT_AWARDED)
    all_closed = F.forall(lot_statuses, lambda status: status == LOT_CLOSED)
    return F.when(
        (kind == AWARD) & (F.size(lot_statuses) > 0),
        F.when(F.coalesce(selected, F.lit(False)), AWARDED).when(all_closed, DESIERTO).otherwise(AWARDED),
    )
