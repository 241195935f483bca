"""Eligibility rules, grading, backtests, cost and the split of hot keys."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import backtest, cost, eligibility, grading
from tenderloom.schemas import PROFILES, TENDERS

FULL_PROFILE = {
    "name": "Full",
    "cpv_prefixes": ["9091", "45"],
    "annual_turnover": 500_000.0,
    "certifications": [" ISO 9001", "Straße 1"],
    "max_contract_value": 1_234_567.5,
}
REQUIREMENTS = "tender_id string, solvency_turnover_required double, required_certifications array<string>"


def tender(key, budget=None, code=None):
    return (key, None, f"title {key}", budget, code, None, [])


@pytest.fixture(scope="module")
def verdicts(spark):
    tenders = spark.createDataFrame(
        [
            tender("good", 1_234_567.5, "90911200"),
            tender("outside", 100.0, "33000000"),
            tender("open", None, None),
            tender("empty code", 2_000_000.0, ""),
            tender("no text", 10.0, "45000000"),
        ],
        TENDERS,
    )
    required = spark.createDataFrame(
        [
            ("good", 500_000.0, ["iso 9001 ", "STRASSE 1"]),
            ("outside", 500_000.5, ["ISO 9001", "ISO 14001", "x"]),
            ("empty code", 0.0, []),
        ],
        REQUIREMENTS,
    )
    found = eligibility.check_company(tenders, FULL_PROFILE, required)
    return {row.tender_id: row for row in eligibility.explain_verdicts(found).collect()}


def outcomes(row):
    return [(check.rule, check.outcome) for check in row.checks]


def test_every_rule_is_listed_in_order(verdicts):
    for row in verdicts.values():
        assert [check.rule for check in row.checks] == ["scope", "solvency", "certifications", "capacity"]


def test_verdicts(verdicts):
    assert {key: row.verdict for key, row in verdicts.items()} == {
        "good": "eligible",
        "outside": "not_eligible",
        "open": "unknown",
        "empty code": "not_eligible",
        "no text": "unknown",
    }


def test_details(verdicts):
    assert [check.detail for check in verdicts["good"].checks] == [
        "CPV 90911200 matches the company's families (9091, 45)",
        "turnover 500,000 EUR vs required 500,000 EUR — meets the floor",
        "holds all required (iso 9001 , STRASSE 1)",
        "budget 1,234,568 EUR vs ceiling 1,234,568 EUR — within capacity",
    ]
    assert verdicts["outside"].blocking_reasons == [
        "CPV 33000000 is outside the company's families (9091, 45)",
        "turnover 500,000 EUR vs required 500,000 EUR — below the floor",
        "missing: ISO 14001, x",
    ]
    assert verdicts["open"].blocking_reasons == []
    assert verdicts["open"].confirm_by_hand == [
        "tender CPV unknown",
        "no turnover requirement found in the pliego",
        "no certification requirement found in the pliego",
        "tender budget unknown",
    ]
    assert verdicts["empty code"].blocking_reasons == [
        "budget 2,000,000 EUR vs ceiling 1,234,568 EUR — exceeds capacity"
    ]


def test_company_without_conditions(spark):
    tenders = spark.createDataFrame([tender("t", 5.0, "45")], TENDERS)
    bare = {"name": "Bare"}
    row = eligibility.check_company(tenders, bare).first()
    assert row.verdict == "unknown"
    assert outcomes(row) == [
        ("scope", "not_applicable"),
        ("solvency", "not_applicable"),
        ("certifications", "unverified"),
        ("capacity", "not_applicable"),
    ]
    assert [check.detail for check in row.checks] == [
        "company declares no CPV families",
        "company turnover not declared",
        "no certification requirement found in the pliego",
        "no self-imposed contract ceiling",
    ]
    asked = spark.createDataFrame([("t", "Bare")], "tender_id string, company string")
    profile = spark.createDataFrame([("Bare", None, None, None, None)], PROFILES)
    assert outcomes(eligibility.check_bids(asked, tenders, profile).first()) == outcomes(row)
    held = spark.createDataFrame([("t", None, ["A"])], REQUIREMENTS)
    assert eligibility.check_company(tenders, bare, held).first().verdict == "not_eligible"


def brute_force_verdict(profile, fields):
    _, prefixes, turnover, held, ceiling = profile
    budget, code, floor, required = fields

    def grade(skip, open_, good):
        return "not_applicable" if skip else "unverified" if open_ else "pass" if good() else "fail"

    held = {h.strip().casefold() for h in held or []}
    found = [
        grade(not prefixes, not code, lambda: any(code.startswith(p) for p in prefixes)),
        grade(turnover is None, floor is None, lambda: turnover >= floor),
        grade(False, not required, lambda: all(r.strip().casefold() in held for r in required)),
        grade(ceiling is None, budget is None, lambda: budget <= ceiling),
    ]
    verdict = "not_eligible" if "fail" in found else "unknown" if "unverified" in found else "eligible"
    return verdict, found


@pytest.mark.parametrize("hot_share", [0.0, 0.4])
def test_pairs_against_brute_force(spark, hot_share):
    chance = random.Random(11)
    profiles = [
        (
            f"C{n}",
            chance.choice([None, [], ["4"], ["9", "45"], [""]]),
            chance.choice([None, 0.0, 50.0, 100.0]),
            chance.choice([None, [], ["a "], ["A", "B"]]),
            chance.choice([None, 0.0, 50.0]),
        )
        for n in range(300)
    ]
    tenders, required, facts = [], [], {}
    for n in range(300):
        key = f"T{n}"
        budget, code = chance.choice([None, 0.0, 50.0, 60.0]), chance.choice([None, "", "45", "90"])
        tenders.append(tender(key, budget, code))
        floor, names = None, None
        if chance.random() < 0.8:
            floor, names = chance.choice([None, 0.0, 60.0]), chance.choice([None, [], ["a"], [" b", "A"]])
            required.append((key, floor, names))
        facts[key] = (budget, code, floor, names)

    def pick(prefix):
        return f"{prefix}0" if chance.random() < hot_share else f"{prefix}{chance.randrange(1, 300)}"

    pairs = sorted({(pick("T"), pick("C")) for _ in range(3000)}) + [("T0", "nobody"), ("nothing", "C0")]
    bids = spark.createDataFrame(pairs, "tender_id string, company string")
    found = eligibility.check_bids(
        bids,
        spark.createDataFrame(tenders, TENDERS),
        spark.createDataFrame(profiles, PROFILES),
        spark.createDataFrame(required, REQUIREMENTS),
    ).collect()
    got = {(r.tender_id, r.company): (r.verdict, [check.outcome for check in r.checks]) for r in found}
    by_name = {profile[0]: profile for profile in profiles}
    expected = {pair: brute_force_verdict(by_name[pair[1]], facts[pair[0]]) for pair in pairs[:-2]}
    assert len(found) == len(expected) and got == expected


# --- grading ----------------------------------------------------------------------------

TRUTH = "tender_id string, budget double, cpv_primary string, deadline date"


def test_grades(spark):
    day = dt.date(2026, 1, 2)
    truth = spark.createDataFrame(
        [
            ("within", 1000.0, "45", day),
            ("outside", 1000.0, " 45", day),
            ("cent", 1.0, "45\t", day),
            ("no truth", None, None, None),
            ("missed", 1000.0, "45", day),
            ("never read", 1000.0, "45", day),
            ("zero", 0.0, "", day),
        ],
        TRUTH,
    )
    got = spark.createDataFrame(
        [
            ("within", 1005.0, "45", day),
            ("outside", 1005.01, "45 ", dt.date(2026, 1, 3)),
            ("cent", 1.009, "45", day),
            ("no truth", 5.0, "45", day),
            ("missed", None, None, None),
            ("zero", 0.01, "", None),
            ("nobody", 1.0, "1", day),
        ],
        TRUTH,
    )
    rows = grading.grade_extractions(truth, got).collect()
    graded = {}
    for row in rows:
        graded.setdefault(row.tender_id, []).append((row.field, row.grade))
    assert all([field for field, _ in pairs] == ["budget", "cpv_primary", "deadline"] for pairs in graded.values())
    short = {key: [grade[:2] for _, grade in pairs] for key, pairs in graded.items()}
    assert short == {
        "within": ["ma", "ma", "ma"],
        "outside": ["mi", "ma", "mi"],
        "cent": ["ma", "ma", "ma"],
        "no truth": ["no", "no", "no"],
        "missed": ["mi", "mi", "mi"],
        "never read": ["mi", "mi", "mi"],
        "zero": ["ma", "ma", "mi"],
    }
    card = {r.field: (r["match"], r.mismatch, r.no_ground_truth, r.accuracy) for r in grading.extraction_scorecard(truth, got).collect()}
    assert card == {
        "budget": (3, 3, 1, 0.5),
        "cpv_primary": (4, 2, 1, 4 / 6),
        "deadline": (2, 4, 1, 2 / 6),
        "overall": (9, 9, 3, 0.5),
    }
    empty = grading.extraction_scorecard(truth.where("false"), got).collect()
    assert [(r.field, r["match"], r.accuracy) for r in empty] == [
        (field, 0, None) for field in ("budget", "cpv_primary", "deadline", "overall")
    ]


# --- backtest ---------------------------------------------------------------------------


def pairs_of(spark, *items):
    predictions = [(f"t{n}", predicted) for n, (predicted, _) in enumerate(items)] + [("unresolved", "awarded")]
    resolved = [(f"t{n}", actual) for n, (_, actual) in enumerate(items)] + [("unpredicted", "desierto")]
    return backtest.pair_predictions(
        spark.createDataFrame(predictions, "tender_id string, predicted string"),
        spark.createDataFrame(resolved, "tender_id string, actual string"),
    )


def test_backtest(spark):
    a, d = "awarded", "desierto"
    pairs = pairs_of(spark, *itertools.repeat((a, a), 6), (a, d), (d, d), (d, a), (d, d))
    row = backtest.backtest_summary(pairs).first()
    assert (row.n, row.accuracy, row.baseline_label, row.baseline_accuracy) == (10, 0.8, a, 0.7)
    assert round(row.lift, 9) == 0.1 and row.beats_baseline is True
    rows = {r.label: r for r in backtest.backtest_per_class(pairs).collect()}
    assert (rows[a].support, rows[a].predicted, rows[a].true_positives) == (7, 7, 6)
    assert (rows[d].support, rows[d].predicted, rows[d].true_positives) == (3, 3, 2)
    assert rows[d].precision == rows[d].recall == 2 / 3 and round(rows[d].f1, 9) == round(2 / 3, 9)
    assert tuple(backtest.majority_baseline(pairs).first()) == (a, 0.7)


def test_backtest_of_a_blind_predictor(spark):
    pairs = pairs_of(spark, ("awarded", "awarded"), ("awarded", "awarded"), ("awarded", "desierto"))
    row = backtest.backtest_summary(pairs).first()
    assert row.lift == 0.0 and row.beats_baseline is False
    rows = {r.label: r for r in backtest.backtest_per_class(pairs).collect()}
    assert rows["desierto"].precision is None and rows["desierto"].recall == 0.0 and rows["desierto"].f1 is None
    wrong = backtest.backtest_per_class(pairs_of(spark, ("desierto", "awarded"), ("awarded", "desierto")))
    assert {r.f1 for r in wrong.collect()} == {None}


def test_backtest_of_nothing(spark):
    pairs = pairs_of(spark)
    assert tuple(backtest.backtest_summary(pairs).first()) == (0, None, None, None, None, False)
    assert backtest.backtest_per_class(pairs).count() == 0
    assert backtest.majority_baseline(pairs).count() == 0


def test_repeated_predictions_count_each_time(spark):
    predictions = spark.createDataFrame([("t", "awarded")] * 5 + [("t", "desierto")], "tender_id string, predicted string")
    resolved = spark.createDataFrame([("t", "awarded")], "tender_id string, actual string")
    row = backtest.backtest_summary(backtest.pair_predictions(predictions, resolved)).first()
    assert (row.n, round(row.accuracy, 6)) == (6, round(5 / 6, 6))


def test_cost(spark):
    frame = spark.createDataFrame([("m", 1_000_000), ("m", 500_000), ("other", 2_000_000), ("free", 0)], "model string, input_tokens long")
    rates = {"m": 1.0, "free": 0.0, "dear": 5.0}
    rows = {r.model: (r.documents, r.input_tokens, r.usd, r.usd_per_document) for r in cost.run_cost(frame, rates).collect()}
    assert rows == {"m": (2, 1_500_000, 1.5, 0.75), "other": (1, 2_000_000, 10.0, 10.0), "free": (1, 0, 0.0, 0.0)}


def test_what_was_not_readable_was_not_read(spark):
    day = dt.date(2026, 1, 2)
    keys = ["pdf", "page", "empty", "absent"]
    gradable = spark.createDataFrame(
        [(k, f"u/{k}", 5.0, "45", day) for k in keys],
        "tender_id string, document_uri string, estimated_value double, cpv_primary string, deadline date",
    )
    landed = spark.createDataFrame([("u/pdf", True), ("u/pdf", True), ("u/page", False), ("u/empty", False)], "uri string, is_pdf boolean")
    got = spark.createDataFrame([(k, 5.0, "45", day) for k in keys], TRUTH)
    card = {r.field: (r.match, r.mismatch) for r in grading.feed_evaluation(gradable, landed, got).collect()}
    assert card == {"budget": (1, 3), "cpv_primary": (1, 3), "deadline": (1, 3), "overall": (3, 9)}
