"""Links between tenders and awards, upserts and checks on the notices table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import links, monitoring, upsert
from tenderloom.schemas import PROCEDURE_LINKS

COLUMNS = (
    "publication_number string, kind string, procedure_id string, publication_date date, "
    "award_outcome string, result_value double"
)


def day(text):
    return dt.date.fromisoformat(text) if text else None


def notices(spark, *rows):
    return spark.createDataFrame([(n, k, p, day(d), o, v) for n, k, p, d, o, v in rows], COLUMNS)


@pytest.fixture(scope="module")
def linked(spark):
    frame = notices(
        spark,
        ("T1", "tender", "P1", "2025-01-01", None, None),
        ("T1b", "tender", "P1", "2025-02-01", None, None),
        ("W1", "award", "P1", "2025-07-01", "awarded", 10.0),
        # the latest award states neither outcome nor value: both come from the one before
        ("T2", "tender", "P2", "2025-01-01", None, None),
        ("W2a", "award", "P2", "2025-03-01", "desierto", 5.0),
        ("W2b", "award", "P2", "2025-04-01", None, None),
        # no award at all, an award without a status, and one from before the tender
        ("T3", "tender", "P3", "2025-01-01", None, None),
        ("T4", "tender", "P4", "2025-01-01", None, None),
        ("W4", "award", "P4", "2025-01-11", None, None),
        ("T5", "tender", "P5", "2025-01-11", None, None),
        ("W5", "award", "P5", "2025-01-01", "awarded", None),
        # undated notices cannot be placed, but the tender still counts
        ("T6", "tender", "P6", None, None, None),
        ("W6", "award", "P6", None, "awarded", 1.0),
        # neither an award alone, nor other kinds, nor legacy notices are linked
        ("W7", "award", "P7", "2025-01-01", "awarded", 1.0),
        ("O8", "other", "P8", "2025-01-01", None, None),
        ("T9", "tender", None, "2025-01-01", None, None),
    )
    return frame, {row.procedure_id: row for row in links.link_procedures(frame).collect()}


def test_link_rows(linked):
    _, rows = linked
    assert set(rows) == {"P1", "P2", "P3", "P4", "P5", "P6"}
    got = {p: (r.tender_pub, r.award_pub, r.outcome, r.result_value, r.lag_days) for p, r in rows.items()}
    assert got["P1"] == ("T1", "W1", "awarded", 10.0, 181)
    assert got["P2"] == ("T2", "W2b", "desierto", 5.0, 90)
    assert got["P3"] == ("T3", None, "unknown", None, None)
    assert got["P4"] == ("T4", "W4", "unknown", None, 10)
    assert got["P5"] == ("T5", "W5", "awarded", None, -10)
    assert got["P6"] == (None, None, "unknown", None, None)


def test_reports_on_links(spark, linked):
    frame, _ = linked
    found = links.link_procedures(frame)
    assert {r.outcome: r.n for r in links.link_outcomes(found).collect()} == {"awarded": 2, "desierto": 1, "unknown": 3}
    assert links.median_lag(found).first()[0] == 50.0
    assert [r.procedure_id for r in links.resolved_outcomes(found).collect()] == ["P1", "P2", "P5"]
    assert [r[0] for r in links.backfill_worklist(frame).collect()] == ["P7"]
    assert links.award_procedures(frame).count() == 6
    nothing = spark.createDataFrame([], PROCEDURE_LINKS)
    assert links.median_lag(nothing).collect()[0][0] is None
    assert links.link_outcomes(nothing).count() == 0


def test_watermarks_and_coverage(spark, linked):
    frame, _ = linked
    marks = {r.kind: (r.watermark, r.resume_from) for r in monitoring.ingest_watermarks(frame).collect()}
    assert marks == {
        "tender": (day("2025-02-01"), day("2025-02-01")),
        "award": (day("2025-07-01"), day("2025-02-01")),
    }
    only_awards = frame.where("kind = 'award'")
    assert {r.resume_from for r in monitoring.ingest_watermarks(only_awards).collect()} == {day("2025-07-01")}
    covered = monitoring.eforms_coverage(frame.withColumn("is_eforms", F.col("procedure_id").isNotNull()))
    rows = {r.kind: (r.total, r.eforms, round(r.eforms_fraction, 3)) for r in covered.collect()}
    assert rows == {"all": (16, 15, 0.938), "tender": (8, 7, 0.875), "award": (7, 7, 1.0), "other": (1, 1, 1.0)}
    empty = monitoring.eforms_coverage(frame.where("false").withColumn("is_eforms", F.lit(True)))
    assert {(r.total, r.eforms_fraction) for r in empty.collect()} == {(0, 0.0)}


def test_one_shuffle_and_no_join(linked):
    frame, _ = linked
    plan = links.link_procedures(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def brute_force_links(rows):
    """The same links by sorting in plain Python."""
    found = {}
    for procedure in {r[2] for r in rows if r[2] is not None and r[1] == "tender"}:
        mine = sorted((r for r in rows if r[2] == procedure and r[3] is not None), key=lambda r: (r[3], r[0]))
        tenders = [r for r in mine if r[1] == "tender"]
        awards = [r for r in mine if r[1] == "award"]
        outcomes = [r[4] for r in awards if r[4] is not None]
        values = [r[5] for r in awards if r[5] is not None]
        found[procedure] = (
            tenders[0][0] if tenders else None,
            awards[-1][0] if awards else None,
            outcomes[-1] if outcomes else "unknown",
            values[-1] if values else None,
        )
    return found


def test_links_against_brute_force_with_a_hot_procedure(spark):
    chance = random.Random(7)
    rows = []
    for number in range(3000):
        procedure = "HOT" if chance.random() < 0.34 else chance.choice([None, f"P{chance.randrange(400)}"])
        date = chance.choice([None, f"2025-{chance.randrange(1, 13):02d}-{chance.randrange(1, 28):02d}"])
        outcome = chance.choice([None, "awarded", "desierto"])
        kind = chance.choice(["tender", "award", "other"])
        rows.append((f"N{number:05d}", kind, procedure, date, outcome, chance.choice([None, float(number)])))
    found = links.link_procedures(notices(spark, *rows).repartition(8)).collect()
    got = {r.procedure_id: (r.tender_pub, r.award_pub, r.outcome, r.result_value) for r in found}
    assert len(found) == len(got) and got == brute_force_links(rows)


def test_relink_equals_a_rebuild(spark, linked):
    frame, _ = linked
    before = links.link_procedures(frame)
    # T3 moves to P7, so P3 is left without a tender and P7 gets one
    after = frame.withColumn(
        "procedure_id", F.when(F.col("publication_number") == "T3", "P7").otherwise(F.col("procedure_id"))
    )
    touched = spark.createDataFrame([("P3",), ("P7",), (None,), ("P7",)], "procedure_id string")
    redone = links.relink(before, after, touched)
    assert sorted(redone.collect(), key=str) == sorted(links.link_procedures(after).collect(), key=str)


def test_upsert(spark):
    existing = spark.createDataFrame([("a", "old"), ("b", None)], "k string, v string")
    batch = spark.createDataFrame([("b", "one", 1), ("b", None, 3), ("c", "new", 1), ("b", "two", 2), (None, "x", 9)], "k string, v string, seq int")
    once = upsert.upsert(existing, batch, "k", "seq")
    assert sorted(map(tuple, once.collect())) == [("a", "old"), ("b", None), ("c", "new")]
    again = upsert.upsert(once, batch, "k", "seq")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    unchanged = upsert.upsert(existing, batch.where("false"), "k", "seq")
    assert sorted(map(tuple, unchanged.collect())) == [("a", "old"), ("b", None)]


def test_a_row_without_an_order_replaces_no_row_that_has_one(spark):
    batch = spark.createDataFrame(
        [("a", "placed", 1), ("a", "x", None), ("b", "x", None), ("c", "low", 2), ("c", "tie", 2), (None, "y", 9)],
        "k string, v string, seq int",
    )
    found = upsert.latest_rows(batch, "k", "seq").collect()
    assert sorted(map(tuple, found)) == [("a", "placed"), ("b", "x"), ("c", "tie")]


def test_report_is_one_pass_with_a_zero_for_kinds_without_rows(spark):
    batch = spark.createDataFrame([("tender",)], "kind string")
    rows = [("awarded", 10), ("awarded", 20), ("unknown", None)]
    linked = spark.createDataFrame(rows, "outcome string, lag_days long")
    report = {(r.measure, r.label): r.value for r in monitoring.dataset_report(batch, linked).collect()}
    assert report == {
        ("ingested", "tender"): 1.0, ("ingested", "award"): 0.0, ("linked", "all"): 3.0, ("outcome", "awarded"): 2.0,
        ("outcome", "unknown"): 1.0, ("median_lag_days", "all"): 15.0,
    }
