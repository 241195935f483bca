"""Feed parsing, search, lookups and landed sources."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import search, tenders
from tenderloom.schemas import NOTICES, TENDERS
from tenderloom.sources import documents, sample, tables, tender_feed

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="urn:atom" xmlns:b="urn:basic" xmlns:a="urn:parts" xmlns:e="urn:ext" xmlns:at="urn:gone">'
FULL = """
<entry>
  <id> urn:tender:1 </id>
  <title>listing title</title>
  <e:ContractFolderStatus>
    <b:ContractFolderID>
      EXP/1 
    </b:ContractFolderID>
    <a:ProcurementProject>
      <b:Name>Bridge &amp; road</b:Name>
      <a:BudgetAmount>
        <b:EstimatedOverallContractAmount currencyID="EUR">900.5</b:EstimatedOverallContractAmount>
        <b:TotalAmount currencyID="EUR">1210</b:TotalAmount>
        <b:TaxExclusiveAmount currencyID="EUR">1000</b:TaxExclusiveAmount>
      </a:BudgetAmount>
      <a:RequiredCommodityClassification><b:ItemClassificationCode listURI="u">45221111</b:ItemClassificationCode></a:RequiredCommodityClassification>
      <a:RequiredCommodityClassification><b:ItemClassificationCode listURI="u">45000000</b:ItemClassificationCode></a:RequiredCommodityClassification>
    </a:ProcurementProject>
    <a:TenderingProcess>
      <a:DocumentAvailabilityPeriod><b:EndDate>2026-07-10</b:EndDate></a:DocumentAvailabilityPeriod>
      <a:TenderSubmissionDeadlinePeriod><b:EndDate>2026-07-13</b:EndDate><b:EndTime>23:59:00</b:EndTime></a:TenderSubmissionDeadlinePeriod>
    </a:TenderingProcess>
    <a:TechnicalDocumentReference><b:ID>ppt.pdf</b:ID><a:Attachment><a:ExternalReference><b:URI>https://d.example/3?a=1&amp;b=2</b:URI></a:ExternalReference></a:Attachment></a:TechnicalDocumentReference>
    <a:LegalDocumentReference><b:ID>pcap.pdf</b:ID><a:Attachment><a:ExternalReference><b:URI>https://d.example/1</b:URI></a:ExternalReference></a:Attachment></a:LegalDocumentReference>
    <a:LegalDocumentReference><b:ID> </b:ID><a:Attachment><a:ExternalReference><b:URI>https://d.example/2</b:URI></a:ExternalReference></a:Attachment></a:LegalDocumentReference>
    <a:LegalDocumentReference><b:ID>no link.pdf</b:ID></a:LegalDocumentReference>
    <a:AdditionalDocumentReference><b:ID>extra</b:ID><a:Attachment><a:ExternalReference><b:URI>https://d.example/9</b:URI></a:ExternalReference></a:Attachment></a:AdditionalDocumentReference>
  </e:ContractFolderStatus>
</entry>"""
BARE = "<entry><title>nothing else</title></entry>"


def budget_entry(number, content):
    return (
        f"<entry><id>{number}</id><e:ContractFolderStatus><a:ProcurementProject><a:BudgetAmount>{content}"
        "</a:BudgetAmount></a:ProcurementProject></e:ContractFolderStatus></entry>"
    )


BUDGETS = {
    "blank": ("<b:TaxExclusiveAmount> </b:TaxExclusiveAmount><b:EstimatedOverallContractAmount>7</b:EstimatedOverallContractAmount>", 7.0),
    "unreadable": ("<b:TaxExclusiveAmount>n/a</b:TaxExclusiveAmount><b:EstimatedOverallContractAmount>7</b:EstimatedOverallContractAmount>", None),
    "total": ("<b:TotalAmount>7</b:TotalAmount>", None),
    "zero": ("<b:TaxExclusiveAmount>0</b:TaxExclusiveAmount>", 0.0),
    "two": ("<b:TaxExclusiveAmount>1</b:TaxExclusiveAmount><b:TaxExclusiveAmount>2</b:TaxExclusiveAmount>", 1.0),
}
LOTS = (
    "<entry><id>lots</id><e:ContractFolderStatus><a:ProcurementProjectLot><a:ProcurementProject><b:Name>Lot one</b:Name>"
    "<a:RequiredCommodityClassification><b:ItemClassificationCode>33</b:ItemClassificationCode></a:RequiredCommodityClassification>"
    "</a:ProcurementProject><a:TenderingProcess><a:TenderSubmissionDeadlinePeriod><b:EndDate>2026-03-04</b:EndDate>"
    "</a:TenderSubmissionDeadlinePeriod></a:TenderingProcess></a:ProcurementProjectLot></e:ContractFolderStatus></entry>"
)


@pytest.fixture(scope="module")
def feed_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    gone = '<id>feed id</id><at:deleted-entry ref="urn:tender:0" when="2026-01-01"/>'
    (folder / "page1.atom").write_text(HEAD + gone + FULL + BARE + LOTS + "</feed>", encoding="utf-8")
    more = "".join(budget_entry(name, content) for name, (content, _) in BUDGETS.items())
    (folder / "page2.atom").write_text(HEAD + more + "</feed>", encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def parsed(spark, feed_folder):
    rows = tenders.parse_entries(tender_feed.scan_entries(spark, feed_folder)).collect()
    return {row.entry_id: row for row in rows}


def test_full_entry(parsed):
    row = parsed["urn:tender:1"]
    assert (row.expediente, row.title, row.budget) == ("EXP/1", "Bridge & road", 1000.0)
    assert (row.cpv_primary, row.deadline) == ("45221111", dt.date(2026, 7, 13))
    assert [tuple(d) for d in row.documents] == [
        ("legal", "pcap.pdf", "https://d.example/1"),
        ("legal", None, "https://d.example/2"),
        ("technical", "ppt.pdf", "https://d.example/3?a=1&b=2"),
    ]


def test_entries_with_gaps(parsed):
    bare = parsed[""]
    assert bare.documents == [] and bare.budget is None and bare.expediente is None
    assert {name: parsed[name].budget for name in BUDGETS} == {name: value for name, (_, value) in BUDGETS.items()}
    assert (parsed["lots"].title, parsed["lots"].cpv_primary) == ("Lot one", "33")
    assert parsed["lots"].deadline == dt.date(2026, 3, 4) and bare.deadline is None
    assert len(parsed) == 3 + len(BUDGETS)


def test_deadline_is_that_of_its_own_block(spark):
    """The scoped reading agrees with an XPath that names the block."""
    text = spark.createDataFrame([(FULL.replace("a:", "").replace("b:", "").replace("e:", ""),)], "x string")
    path = "(//TenderSubmissionDeadlinePeriod)[1]//EndDate/text()"
    assert text.select(F.expr(f"get(xpath(x, '{path}'), 0)")).first()[0] == "2026-07-13"


def test_broken_feed_fails(spark, tmp_path):
    (tmp_path / "broken.atom").write_text(HEAD + "<entry><id>1</id>")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        tender_feed.scan_entries(spark, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def stored(spark):
    legal = [("legal", "a.pdf", "u1"), ("legal", "b.pdf", "u2")]
    rows = [
        ("t1", "x1", "One", 100.0, "45100000", dt.date(2026, 1, 2), legal),
        ("t2", "x2", "Two", None, "45200000", None, []),
        ("t3", "x3", "Three", 300.0, "90000000", None, [("technical", None, "u3")]),
        ("t4", "x4", "Four", 0.0, None, None, legal),
        ("", "x5", "Five", None, None, None, legal),
        ("t6", None, "Six", None, "", None, [("legal", None, "u6")]),
        ("t7", "x7", "Seven", 300.0, "4510", None, []),
    ]
    return spark.createDataFrame(rows, TENDERS)


def ids(frame):
    return [row.tender_id for row in frame.collect()]


def test_search(stored):
    assert ids(search.search_tenders(stored)) == ["t3", "t7", "t1", "t4", "", "t2", "t6"]
    assert ids(search.search_tenders(stored, cpv_prefix="451")) == ["t7", "t1"]
    assert ids(search.search_tenders(stored, cpv_prefix="")) == ids(search.search_tenders(stored))
    assert ids(search.search_tenders(stored, cpv_prefix="4_1")) == []
    assert ids(search.search_tenders(stored, min_budget=100.0)) == ["t3", "t7", "t1"]
    assert ids(search.search_tenders(stored, max_budget=100.0)) == ["t1", "t4"]
    assert ids(search.search_tenders(stored, max_budget=0)) == ["t4"]
    assert ids(search.search_tenders(stored, min_budget=0.0, limit=2)) == ["t3", "t7"]


def test_lookups(spark, stored):
    row = search.get_tender(stored, "t1").collect()
    assert len(row) == 1 and (row[0].deadline, row[0].documents) == ("2026-01-02", 2)
    assert [d.uri for d in row[0].document_links] == ["u1", "u2"]
    assert search.get_tender(stored, "none").count() == 0
    wanted = spark.createDataFrame([("t1",), ("t1",), ("zz",), ("t3",)], "tender_id string")
    assert sorted(ids(search.get_tenders(stored, wanted))) == ["t1", "t3"]
    assert search.document_links(stored).count() == 8
    assert tuple(search.document_coverage(stored).first()) == (7, 5)


def test_gradable(stored):
    rows = {r.tender_id: r.document_uri for r in search.gradable_tenders(stored).collect()}
    assert rows == {"t1": "u1", "t4": "u1", "t6": "u6"}


def test_as_notices(stored):
    found = tenders.as_notices(stored)
    assert found.columns == NOTICES.names
    rows = {r.title: r for r in found.collect()}
    assert [rows[t].publication_number for t in ("One", "Five", "Six")] == ["t1", "x5", "t6"]
    assert rows["One"].cpv == ["45100000"] and rows["Four"].cpv == [] and rows["Six"].cpv == []
    assert rows["One"].is_eforms is False and rows["One"].award_outcome is None
    nameless = stored.limit(1).withColumn("entry_id", F.lit("")).withColumn("expediente", F.lit(None).cast("string"))
    assert tenders.as_notices(nameless).first().publication_number == "unknown"


def test_parallel_lists(spark):
    frame = spark.createDataFrame(
        [(["legal", "technical"], ["", "b"], ["u1", "u2", "u3"]), (None, None, None)],
        "k array<string>, n array<string>, u array<string>",
    )
    rows = frame.select(tenders.zip_documents(F.col("k"), F.col("n"), F.col("u")).alias("d")).collect()
    assert [[tuple(d) for d in row.d] for row in rows] == [[("legal", None, "u1"), ("technical", "b", "u2")], []]


def test_award_history(spark):
    rows = [
        ("w1", "award", "45100000", "A", 5.0, ["x"], "awarded"),
        ("w2", "award", "45200000", "B", None, None, None),
        ("w3", "award", "45300000", "C", 9.0, [], "desierto"),
        ("w4", "award", "90000000", "D", 99.0, ["y"], "awarded"),
        ("t5", "tender", "45100000", "E", None, None, None),
    ]
    frame = spark.createDataFrame(
        rows,
        "publication_number string, kind string, cpv_primary string, title string, result_value double, "
        "winner_names array<string>, award_outcome string",
    )
    listed = search.past_awards(frame, "45", limit=10).collect()
    assert [(r.notice, r.winners, r.outcome) for r in listed] == [
        ("w3", [], "desierto"), ("w1", ["x"], "awarded"), ("w2", [], None)
    ]
    assert search.past_awards(frame, "45", limit=1).count() == 1
    assert {r.outcome: r.n for r in search.award_outcome_counts(frame, "45").collect()} == {"awarded": 1, "desierto": 1}


def test_table_not_ingested_yet(spark, tmp_path):
    nothing = tables.read_or_empty(spark, str(tmp_path / "notices"), NOTICES)
    assert search.past_awards(nothing, "45").count() == 0
    assert search.award_outcome_counts(nothing, "45").count() == 0
    assert tables.table_or_empty(spark, "no_such_table", NOTICES).columns == NOTICES.names


def test_documents_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "real.txt").write_bytes(b"%PDF-1.4 rest")
    (tmp_path / "fake.pdf").write_bytes(b"<html>%PDF-</html>")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "short.pdf").write_bytes(b"%PDF")
    rows = documents.scan_documents(spark, str(tmp_path)).collect()
    assert {row.path.rsplit("/", 1)[1]: row.is_pdf for row in rows} == {
        "real.txt": True, "fake.pdf": False, "short.pdf": False
    }


MOVED = """
<entry><wrap><x:id>m1</x:id></wrap><other><e:ContractFolderStatus><inner><b:ContractFolderID>EXP/9</b:ContractFolderID></inner>
  <part><a:ProcurementProject><deep><b:Name>Moved &lt;name&gt;</b:Name></deep>
    <deep><a:BudgetAmount><x><b:TaxExclusiveAmount> </b:TaxExclusiveAmount></x><b:EstimatedOverallContractAmount>5</b:EstimatedOverallContractAmount></a:BudgetAmount></deep>
    <codes><b:ItemClassificationCode>45</b:ItemClassificationCode></codes></a:ProcurementProject></part>
  <a:DocumentAvailabilityPeriod><b:EndDate>2026-01-01</b:EndDate></a:DocumentAvailabilityPeriod>
  <process><a:TenderSubmissionDeadlinePeriod><x><b:EndDate>2026-02-02+01:00</b:EndDate></x></a:TenderSubmissionDeadlinePeriod></process>
  <!-- <a:LegalDocumentReference><b:URI>https://d.example/not</b:URI></a:LegalDocumentReference> -->
  <docs><a:TechnicalDocumentReference><b:URI>https://d.example/t</b:URI></a:TechnicalDocumentReference>
    <a:LegalDocumentReference kind="x"><b:ID>l.pdf</b:ID><link><b:URI>https://d.example/l?a=1&amp;b=2</b:URI></link></a:LegalDocumentReference></docs>
</e:ContractFolderStatus></other></entry>"""


def test_elements_at_any_depth(spark):
    bodies = [MOVED, FULL, BARE, *[budget_entry(name, content) for name, (content, _) in BUDGETS.items()]]
    texts = spark.createDataFrame([(k, body) for k, body in enumerate(bodies)], "n int, entry string")
    found = {r.n: r for r in tenders.parse_entries_anywhere(texts).collect()}
    moved = found[0]
    assert (moved.entry_id, moved.expediente, moved.title, moved.budget, moved.cpv_primary, moved.deadline) == (
        "m1", "EXP/9", "Moved <name>", 5.0, "45", dt.date(2026, 2, 2),
    )
    assert [tuple(d) for d in moved.documents] == [
        ("legal", "l.pdf", "https://d.example/l?a=1&b=2"), ("technical", None, "https://d.example/t"),
    ]
    # Where all is at its declared path the two forms agree, and the fast one is completed where it is not.
    declared = tenders.parse_entries(tender_feed.read_entries(texts.withColumn("text", F.col("entry"))))
    plain = {r.n: r for r in declared.collect()}
    whole = {r.n: r for r in tenders.complete_entries(declared, "text").collect()}
    for n in range(1, len(bodies)):
        assert all(plain[n][name] == found[n][name] == whole[n][name] for name in TENDERS.names), bodies[n]
    assert plain[0].title is None and all(whole[0][name] == moved[name] for name in TENDERS.names)


def test_dense_parts_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    rows = [(k, f"name {k}", 5, float(k)) for k in range(400)]
    parts = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = sample.feed_entries(spark, str(tmp_path))
    held = {r.task: r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("entry").alias("n")).collect()}
    assert sum(held.values()) == 400 and len(held) == 8 and max(held.values()) < 100


def test_an_entry_is_parsed_once_for_all_values(spark):
    entries = spark.createDataFrame([("<entry><id>1</id></entry>",)], "entry string")
    read = tenders.parse_entries_anywhere(entries).where("entry_id <> '' and budget is null")
    # One path for the entry, and one in each kind of references.
    assert len(re.findall(r"xpath_string|XPathString", read._jdf.queryExecution().optimizedPlan().toString())) == 3


def test_odd_entries_at_any_depth(spark):
    texts = [
        "<entry/>",
        "<entry><id> </id><Name>no project</Name><EndDate>2026-01-01</EndDate></entry>",
        "<entry><x><id>a, b|c</id></x><BudgetAmount><TaxExclusiveAmount> </TaxExclusiveAmount>"
        "<EstimatedOverallContractAmount>7</EstimatedOverallContractAmount></BudgetAmount><ContractFolderID>'f\"</ContractFolderID></entry>",
        None,
    ]
    found = tenders.parse_entries_anywhere(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, entry string"))
    rows = {r.n: (r.entry_id, r.expediente, r.title, r.budget, r.cpv_primary, r.deadline, r.documents) for r in found.collect()}
    blank = ("", None, None, None, None, None, [])
    assert rows == {0: blank, 1: blank, 2: ("a, b|c", "'f\"", None, 7.0, None, None, []), 3: blank}
