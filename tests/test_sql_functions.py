"""Table functions against the DataFrame jobs, deletion marks of the feed, and sketches of lags."""

from __future__ import annotations

import os
import random
import statistics
import time

import pytest

from tenderloom.operators import eligibility, links, monitoring, search, upsert
from tenderloom.plans.sql_functions import register_functions
from tenderloom.schemas import NOTICES
from tenderloom.sources import sample as tables
from tenderloom.sources.tender_feed import scan_entries, scan_marks


@pytest.fixture
def views(spark, sample):
    for name in ("tenders", "notices", "requirements"):
        getattr(tables, name)(spark, sample).createOrReplaceTempView(name)
    register_functions(spark)
    yield spark
    for name in ("tenders", "notices", "requirements"):
        spark.catalog.dropTempView(name)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize(
    "call, wanted",
    [
        ("", {}),
        ("'45'", {"cpv_prefix": "45"}),
        ("''", {"cpv_prefix": ""}),
        ("'%'", {"cpv_prefix": "%"}),
        ("min_budget => 0, most => 7", {"min_budget": 0, "limit": 7}),
        ("'5', max_budget => 950000.0, min_budget => 900000.0", {"cpv_prefix": "5", "max_budget": 950000.0, "min_budget": 900000.0}),
    ],
)
def test_search(views, sample, call, wanted):
    found = views.sql(f"SELECT * FROM search_tenders({call})")
    assert rows(found) == rows(search.search_tenders(tables.tenders(views, sample), **wanted))
    assert found.columns == search.tender_summary(tables.tenders(views, sample)).columns


def test_a_search_is_a_top_k(views):
    text = views.sql("SELECT * FROM search_tenders('45', most => 3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in text or "WindowGroupLimit" in text


def test_other_functions(views, sample):
    notices, tenders = tables.notices(views, sample), tables.tenders(views, sample)
    assert rows(views.sql("SELECT * FROM past_awards('45', 4)")) == rows(search.past_awards(notices, "45", 4))
    assert rows(views.sql("SELECT * FROM award_outcome_counts('1')")) == rows(search.award_outcome_counts(notices, "1"))
    assert rows(views.sql("SELECT * FROM tender_details('PT-4')")) == rows(search.get_tender(tenders, "PT-4"))
    assert views.sql("SELECT * FROM tender_details('none')").count() == 0


@pytest.mark.parametrize(
    "call, profile",
    [
        ("", {}),
        ("array('4', NULL), 3e5, array('\\tISO 9001 ', 'iso 14001'), 9.5e5",
         {"cpv_prefixes": ["4", None], "annual_turnover": 3e5, "certifications": ["\tISO 9001 ", "iso 14001"], "max_contract_value": 9.5e5}),
        ("certifications => array('ISO 9001')", {"certifications": ["ISO 9001"]}),
    ],
)
def test_eligibility(views, sample, call, profile):
    checked = eligibility.check_company(
        tables.tenders(views, sample), {"name": "x"} | profile, tables.requirements(views, sample)
    )
    outcomes = [f"checks[{k}].outcome" for k in range(4)]
    found = views.sql(f"SELECT * FROM company_eligibility({call})")
    assert rows(found) == rows(checked.selectExpr("tender_id", "title", "verdict", *outcomes))


def test_names_are_folded_as_in_the_jobs(views, sample):
    held = ["STRASSE ı", "\u2003İso\x85", "ΟΔΟΣ", "None"]
    asked = [("PT-1", ["Straße ı", " i̇SO "]), ("PT-2", ["strasse i"]), ("PT-3", ["οδος", "NONE"]), ("PT-4", [None])]
    required = views.createDataFrame(asked, "tender_id string, required_certifications array<string>").selectExpr(
        "tender_id", "CAST(NULL AS DOUBLE) AS solvency_turnover_required", "required_certifications"
    )
    required.createOrReplaceTempView("requirements")
    register_functions(views)
    checked = eligibility.check_company(tables.tenders(views, sample), {"name": "x", "certifications": held}, required)
    listed = ", ".join(f"'{name}'" for name in held)
    found = views.sql(f"SELECT tender_id, certification FROM company_eligibility(certifications => array({listed}))")
    assert rows(found) == rows(checked.selectExpr("tender_id", "checks[2].outcome"))


def test_functions_over_views_that_are_not_there(spark):
    register_functions(spark)
    assert spark.sql("SELECT * FROM search_tenders()").count() == 0
    assert spark.table("notices").columns == NOTICES.names
    for name in ("tenders", "notices", "requirements"):
        spark.catalog.dropTempView(name)


def test_marks_take_out_and_later_rows_bring_back(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("z", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 2, 5), ("b", 2, 7), ("d", 2, 3), ("e", 2, 4), ("b", 9, 1)], "k string, v int, t int")
    marks = spark.createDataFrame([("a", 6), ("b", 6), ("c", 1), ("d", 3), ("e", 4), ("e", 9), ("f", 1), (None, 9)], "k string, t int")
    found = upsert.upsert_marked(existing, batch, marks, "k", "t")
    # a: removed after its row; b: brought back; c: removed; d: row and mark at one place; e: removed by the later mark.
    assert rows(found) == [("b", 2), ("d", 2), ("z", 1)]
    assert rows(upsert.upsert_marked(existing, batch.limit(0), marks.limit(0), "k", "t")) == rows(existing)


def test_marks_of_feed_pages(spark, tmp_path):
    def page(name, body, age):
        path = tmp_path / name
        path.write_text(f'<feed xmlns="urn:f" xmlns:at="urn:t">{body}</feed>')
        os.utime(path, (time.time() - age,) * 2)

    page("1.atom", "<entry><id>t1</id></entry><entry><id>t2</id></entry><entry><id>t3</id></entry>", 300)
    page("2.atom", '<at:deleted-entry ref="t1" when="2025-01-01"/><at:deleted-entry ref="t2"/><entry><id>t2</id></entry>', 200)
    marks = scan_marks(spark, str(tmp_path))
    assert sorted(r.entry_id for r in marks.collect()) == ["t1", "t2"]
    entries = scan_entries(spark, str(tmp_path)).selectExpr("id[0]._VALUE AS entry_id", "1 AS v", "landed")
    none = spark.createDataFrame([], "entry_id string, v int")
    assert rows(upsert.upsert_marked(none, entries, marks, "entry_id", "landed")) == [("t2", 1), ("t3", 1)]


def test_sketches_of_days_merge_to_the_median_of_a_window(spark):
    draw = random.Random(3)
    made = [(f"2025-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}", int(draw.gauss(200, 90))) for _ in range(20_000)]
    linked = spark.createDataFrame(made + [("2025-01-01", None)], "award_date string, lag_days long").selectExpr(
        "CAST(award_date AS DATE) AS award_date", "lag_days"
    )
    sketches = monitoring.lag_sketches(linked)
    for begin, end in ((None, None), ("2025-03-01", "2025-04-30"), ("2025-12-28", None)):
        lags = sorted(lag for day, lag in made if (begin or "") <= day <= (end or "9"))
        found = monitoring.approximate_median_lag(sketches, begin, end).first()
        assert found.n == len(lags)
        rank = sum(lag <= found.median_lag_days for lag in lags) / len(lags)
        assert abs(rank - 0.5) < 0.03 and abs(found.median_lag_days - statistics.median(lags)) < 20
    assert tuple(monitoring.approximate_median_lag(sketches, "2030-01-01").first()) == (0, None)
    exact = links.median_lag(linked).first()[0]
    assert abs(monitoring.approximate_median_lag(sketches).first().median_lag_days - exact) < 10
