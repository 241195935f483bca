"""Typing of raw hits, classification and outcomes."""

from __future__ import annotations

import datetime as dt
import json
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderloom.functions.outcomes import award_outcome, notice_kind
from tenderloom.functions.text import fold_case, leading_date, strip, to_number
from tenderloom.operators.normalize import normalize_notices, require_keyed, split_unkeyed
from tenderloom.plans import queries
from tenderloom.schemas import NOTICES
from tenderloom.sources import sample as tables


TITLES = [
    ({"eng": "english", "spa": "español"}, "español"),
    ({"deu": "deutsch", "eng": ["first", "second"]}, "first"),
    ({"pol": "polski", "ces": "česky"}, "polski"),
    ({"spa": ["", "later"], "eng": "ok"}, "ok"),
    ({"spa": [], "fra": ["", "x"], "ita": "ciao"}, "ciao"),
    ({"spa": 7, "eng": None, "fra": "oui"}, "oui"),
    ({"spa": "", "eng": ""}, None),
    ({}, None),
    ("plain", "plain"),
    ("[not a list] {nor a map}", "[not a list] {nor a map}"),
    ("{curly", "{curly"),
    ("", None),
    (["listed"], None),
    (12, None),
    (True, None),
    (None, None),
]

WINNERS = [
    ({"spa": ["A", "B", "A", ""]}, ["A", "B"]),
    ({"eng": ["E"], "spa": ["S1", "S2"]}, ["S1", "S2"]),
    ({"spa": [""], "eng": ["b"]}, []),
    ({"spa": "", "eng": "one"}, ["one"]),
    ({"spa": [], "pol": ["P"], "ces": ["C"]}, ["P"]),
    ("Single", ["Single"]),
    ("", []),
    (["listed"], []),
    (None, []),
]

CODES = [
    (["30", "40", "30"], ["30", "40"]),
    ("30", ["30"]),
    (30, ["30"]),
    ([None, "a", 5], ["a", "5"]),
    ([], []),
]

VALUES = [(["n/a", "12.5", "3"], 12.5), ("7", 7.0), (7.25, 7.25), ([], None), (["x"], None), ("12d", None), ("1_000", 1000.0)]

DATES = [
    ("2025-01-02+01:00", dt.date(2025, 1, 2)),
    (["2025-03-04+01:00", "2020-01-01"], dt.date(2025, 3, 4)),
    ([None, "2025-03-04"], None),
    ("2025-02-30", None),
    ("2025-1-2", None),
    ("2025-1-2 10", None),
    ("not a date", None),
    ([], None),
    (20250102, None),
]

IDENTIFIERS = [("p-1", "p-1", True), ("", "", True), (None, None, False)]


FIELDS = {
    "notice-title": TITLES,
    "winner-name": WINNERS,
    "classification-cpv": CODES,
    "estimated-value-lot": VALUES,
    "publication-date": DATES,
    "procedure-identifier": IDENTIFIERS,
}


@pytest.fixture(scope="module")
def typed(spark):
    """All cases typed by one job: (field, place of the case) -> row."""
    hits = [(-1, "none", json.dumps({"publication-number": "1-2025", "notice-type": "cn-standard"}))]
    for field, cases in FIELDS.items():
        for place, case in enumerate(cases):
            hit = {"publication-number": "1-2025", "notice-type": "cn-standard", field: case[0]}
            hits.append((place, field, json.dumps(hit)))
    frame = spark.createDataFrame(hits, "place int, field string, notice string")
    return {(row.field, row.place): row for row in normalize_notices(frame).collect()}


def outcomes(typed, field, column):
    return [getattr(typed[field, place], column) for place in range(len(FIELDS[field]))]


def test_multilingual_text(typed):
    assert outcomes(typed, "notice-title", "title") == [expected for _, expected in TITLES]


def test_winner_names(typed):
    assert outcomes(typed, "winner-name", "winner_names") == [expected for _, expected in WINNERS]


def test_absent_fields(typed):
    row = typed["none", -1]
    assert (row.cpv, row.winner_names, row.tender_values, row.winner_selection_status) == ([], [], [], [])
    assert row.cpv_primary is None and row.deadline is None and row.estimated_value is None
    assert row.is_eforms is False and row.award_outcome is None
    assert row.asDict().keys() == {"place", "field", *NOTICES.names}


def test_codes(typed):
    assert outcomes(typed, "classification-cpv", "cpv") == [expected for _, expected in CODES]
    firsts = [expected[0] if expected else None for _, expected in CODES]
    assert outcomes(typed, "classification-cpv", "cpv_primary") == firsts


def test_first_value(typed):
    assert outcomes(typed, "estimated-value-lot", "estimated_value") == [expected for _, expected in VALUES]


def test_dates(typed):
    assert outcomes(typed, "publication-date", "publication_date") == [expected for _, expected in DATES]


def test_procedure_identifier(typed):
    assert outcomes(typed, "procedure-identifier", "procedure_id") == [case[1] for case in IDENTIFIERS]
    assert outcomes(typed, "procedure-identifier", "is_eforms") == [case[2] for case in IDENTIFIERS]


def test_hits_without_a_number(spark):
    hits = spark.createDataFrame([('{"publication-number":"1"}',), ('{"notice-type":"cn"}',), ("broken",)], "notice string")
    keyed, unkeyed = split_unkeyed(normalize_notices(hits))
    assert (keyed.count(), unkeyed.count()) == (1, 2)
    with pytest.raises(Exception, match="without a publication number"):
        require_keyed(normalize_notices(hits)).collect()


def test_kinds(spark):
    given = {"can-standard": "award", "can": "award", "cn-social": "tender", "pin-only": "other", "": "other", "c": "other"}
    frame = spark.createDataFrame([(name,) for name in given], "t string")
    assert {row.t: row.kind for row in frame.select("t", notice_kind(F.col("t")).alias("kind")).collect()} == given


def test_award_outcome(spark):
    cases = [
        ("award", ["selec-w"], "awarded"),
        ("award", ["clos-nw", "clos-nw"], "desierto"),
        ("award", ["clos-nw", "selec-w"], "awarded"),
        ("award", ["clos-nw", "open-nw"], "awarded"),
        ("award", [], None),
        ("tender", ["selec-w"], None),
        ("other", ["clos-nw"], None),
    ]
    frame = spark.createDataFrame(cases, "k string, s array<string>, expected string")
    found = frame.select("expected", award_outcome(F.col("k"), F.col("s")).alias("got")).collect()
    assert [row.got for row in found] == [row.expected for row in found]


def test_numbers_read_as_python_reads_them(spark):
    texts = "1 -1 +1.5 .5 5. 1e3 1E-2 1_000 1__0 _1 12d 0x1 nan -inf Infinity +NaN 1,5 abc 1e 2f".split() + [" 7\t", "", "٣x"]

    def python(text):
        try:
            return float(text)
        except ValueError:
            return None

    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    got = {row.t: row.n for row in frame.select("t", to_number(F.col("t")).alias("n")).collect()}
    assert {t: repr(v) for t, v in got.items()} == {t: repr(python(t)) for t in texts}


def test_white_space_and_case_of_every_letter(spark):
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    frame = spark.createDataFrame([(c, f"{c}x{c}") for c in letters], "c string, padded string")
    rows = frame.select("c", strip(F.col("padded")).alias("stripped"), fold_case(F.col("c")).alias("folded")).collect()
    assert [row.c for row in rows if row.stripped != f"{row.c}x{row.c}".strip()] == []
    by_ours: dict[str, set[str]] = {}
    by_python: dict[str, set[str]] = {}
    for row in rows:
        by_ours.setdefault(row.folded, set()).add(row.c)
        by_python.setdefault(row.c.strip().casefold(), set()).add(row.c)
    assert {frozenset(group) for group in by_ours.values()} == {frozenset(group) for group in by_python.values()}


def test_leading_date_keeps_the_day(spark):
    frame = spark.createDataFrame([("2025-01-02+14:00",), ("2025-01-02-11:00",)], "t string")
    assert {row[0] for row in frame.select(leading_date(F.col("t"))).collect()} == {dt.date(2025, 1, 2)}


@pytest.mark.parametrize("value", ["7", "1.5", "1e400", "true", "null", "[]", "{}", '[["a"]]', '[{"a":"b"}]', "[7]"])
def test_only_json_strings_are_texts(spark, value):
    """Also as the value of a language, or as the first of its list."""
    hits = [f'{{"publication-number":"1","notice-title":{shape}}}' for shape in (value, f'{{"spa":{value},"eng":"e é"}}')]
    found = normalize_notices(spark.createDataFrame([(hit,) for hit in hits], "notice string")).collect()
    assert [r.title for r in found] == [None, "e é"]


def test_sample_pages_are_landed_compressed_in_files_of_some_pages(spark, sample, monkeypatch):
    monkeypatch.setattr(queries, "_LANDED", {})
    monkeypatch.setattr(queries, "PAGES_A_FILE", 50)
    scanned = queries.queries()["scan_ted_pages"](spark, sample)
    [folder] = queries._LANDED.values()
    files = list(Path(folder.removeprefix("file:")).glob("part-*"))
    pages = tables.notice_pages(spark, sample).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("size")).first()
    assert len(files) >= pages.n / 50
    assert sum(file.stat().st_size for file in files) < pages.size / 4
    assert scanned.count() == queries.queries()["normalize_notices"](spark, sample).count()


def test_first_entries_and_languages_are_read_without_paths_that_may_not_fit(spark):
    text = typed_plan(spark)
    assert "$[0]" not in text and "$.spa" not in text and "variant" in text


def typed_plan(spark):
    return normalize_notices(spark.createDataFrame([("{}",)], "notice string"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("title", "date", "expected"),
    [
        ({"spa": None, "eng": ["", "x"], "fra": "f"}, [["2024-01-02"]], ("f", None)),
        ({"eng": [["in"]], "spa": {"a": "b"}}, [None, "2024-01-02"], (None, None)),
        ([None, "second"], ["2024-01-02", 5], (None, dt.date(2024, 1, 2))),
        (["first", {"a": 1}], [], (None, None)),
        ({"SPA": "upper", "spa": "lower"}, "2024-01-02Z", ("lower", dt.date(2024, 1, 2))),
        ({}, {"a": 1}, (None, None)),
        (True, 7, (None, None)),
    ],
)
def test_odd_shapes_of_titles_and_dates(spark, title, date, expected):
    hit = json.dumps({"publication-number": "1", "notice-title": title, "publication-date": date})
    row = normalize_notices(spark.createDataFrame([(hit,)], "notice string")).first()
    assert (row.title, row.publication_date) == expected
