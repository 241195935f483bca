"""Plans over stored tables: what is read, what is shuffled, and what must not appear."""

from __future__ import annotations

import re

import pytest

from tenderloom.operators import backtest, eligibility, grading, links, search, tenders, upsert
from tenderloom.plans import queries
from tenderloom.schemas import NOTICES
from tenderloom.sources import sample as tables
from tenderloom.sources.tables import write_partitioned


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sample, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    write_partitioned(tables.notices(spark, sample), f"{folder}/notices")
    tables.tenders(spark, sample).write.parquet(f"{folder}/tenders")
    return (
        spark.read.schema(NOTICES).parquet(f"{folder}/notices"),
        spark.read.parquet(f"{folder}/tenders"),
    )


def test_award_history_reads_only_awards_of_the_family(stored):
    text = plan(search.past_awards(stored[0], "45"))
    assert re.search(r"PartitionFilters: \[.*kind#\d+ = award", text)
    assert "StringStartsWith(cpv_primary,45)" in text
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text
    assert "buyer_name" not in text.split("ReadSchema:")[1]


def test_links_read_six_columns_and_shuffle_once(stored):
    text = plan(links.link_procedures(stored[0]))
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    names = {column.split(":")[0] for column in read.split(",")}
    assert names == {"publication_number", "procedure_id", "publication_date", "award_outcome", "result_value"}
    assert "PartitionFilters: [kind#" in text and "IsNotNull(procedure_id)" in text
    assert text.count("Exchange") == 1 and "Join" not in text


def test_relink_shuffles_only_what_is_touched(spark, stored):
    linked = links.link_procedures(stored[0])
    touched = stored[0].where("cpv_primary = '45000000'").select("procedure_id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(links.touched_links(stored[0], touched))
        whole = plan(links.relink(linked, stored[0], touched))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Below the shuffle of the reduced notices: partial reduction, then the broadcast of buckets, then the scan.
    reduced = text[text.index("partial_max") :]
    below = reduced[: reduced.index("FileScan")]
    assert "BroadcastHashJoin" in below and "LeftSemi" in below and "Exchange hashpartitioning" not in below
    assert "award_outcome" in reduced.split("FileScan")[1].split("\n")[0]
    assert "LeftAnti, BuildRight" in whole and "BroadcastHashJoin" in whole


def test_no_job_runs_while_bids_are_planned(spark, sample, stored):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    args = tables.bids(spark, sample), stored[1], tables.profiles(spark, sample), tables.requirements(spark, sample)
    before = len(tracker.getJobIdsForGroup("planning"))
    plan(eligibility.check_bids(*args))
    assert len(tracker.getJobIdsForGroup("planning")) == before


def test_search_is_a_top_k_over_pushed_filters(stored):
    text = plan(search.search_tenders(stored[1], "5", max_budget=950_000.0))
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(budget,950000.0)" in text
    assert "Exchange" not in plan(search.get_tender(stored[1], "PT-1"))
    assert "EqualTo(entry_id,PT-1)" in plan(search.get_tender(stored[1], "PT-1"))


def test_no_product_of_companies_and_tenders(spark, sample, stored):
    checked = eligibility.check_bids(
        tables.bids(spark, sample), stored[1], tables.profiles(spark, sample), tables.requirements(spark, sample)
    )
    text = plan(checked)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    only_verdicts = plan(checked.select("tender_id", "company", "verdict"))
    assert "format_number" not in only_verdicts


def test_one_company_needs_no_shuffle_of_its_own(stored):
    assert "Exchange" not in plan(eligibility.check_company(stored[1], {"name": "One", "cpv_prefixes": ["4"]}))


def test_scores_come_from_one_aggregation(spark, sample, stored):
    card = plan(grading.extraction_scorecard(
        grading.truth_fields(tenders.as_notices(stored[1])), tables.extractions(spark, sample)
    ))
    assert "Expand" not in card
    resolved = links.resolved_outcomes(links.link_procedures(stored[0]))
    summary = plan(backtest.backtest_summary(backtest.pair_predictions(tables.predictions(spark, sample), resolved)))
    assert "rangepartitioning" not in summary


def test_entries_and_hits_are_parsed_once(spark, sample):
    optimized = lambda name: queries.queries()[name](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_xml|XmlToStructs", optimized("feed_scorecard"))) == 1
    assert len(re.findall(r"from_xml|XmlToStructs", optimized("parse_tenders"))) == 1
    # One parse of all fields; texts in other languages than the preferred ones are parsed apart.
    assert optimized("ingest_quarantine").count("from_json") == 1


def test_upsert_does_not_rank(spark, sample, stored):
    batch = upsert.latest_rows(tables.notice_corrections(spark, sample), "publication_number", "landed")
    assert "Window" not in plan(batch) and "partial_max" in plan(batch)


def test_no_python_in_any_plan(spark, sample):
    for name, query in queries.queries().items():
        text = plan(query(spark, sample))
        assert not re.search(r"(PythonUDF|ArrowEval|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas)", text), name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_notices_are_put_together_once_before_links_are_redone(spark, sample):
    """What links are compared with is stored, so the award notices are not worked out again for each reader."""
    text = queries.queries()["incremental_dataset"](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in text and "o_orderkey" not in text
    relinked = queries.queries()["relink_procedures"](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the notices after the corrections; links and touched procedures are read from files.
    assert relinked.count("lineitem") + relinked.count("collect_list") <= 2, relinked


def test_texts_of_hits_are_not_told_by_their_schema(spark, sample):
    text = queries.queries()["scan_ted_pages"](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in text and "schemaofvariant" not in text.lower()
