"""Every query of the package over the sample tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.outcomes import notice_kind
from tenderloom.operators import backtest, cost, eligibility, families, grading, links, monitoring, search, tenders, upsert
from tenderloom.operators.normalize import normalize_notices, require_keyed
from tenderloom.plans import sql_functions
from tenderloom.plans.dataset import apply_batch, select_window
from tenderloom.schemas import TENDER
from tenderloom.session import shared_folder, spread, stored
from tenderloom.sources import documents, folder_table, notice_pages, sample, tender_feed
from tenderloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the sample queries; the expected results in `oracle` use them too.
FAMILY = "45"
SEARCH_FAMILY = "5"
LOWEST_BUDGET, HIGHEST_BUDGET = 901_000.0, 1_000_000.0
WINDOW = ("1996-03-01", "1998-06-30")
COUNTRY = "NATION_7"
ONE_TENDER = "PT-41"
RATES = {"model-a": 5.0, "model-b": 1.0}
ONE_COMPANY = {
    "name": "Example S.L.",
    "cpv_prefixes": ["1", "45"],
    "annual_turnover": 300_000.0,
    "certifications": ["iso 9001"],
    "max_contract_value": 950_000.0,
}


def _joined(values: str | Column) -> Column:
    return F.array_join(values, "|")


def _joined_documents(documents: str) -> Column:
    described = F.transform(
        documents, lambda d: F.concat_ws(";", d["kind"], F.coalesce(d["name"], F.lit("-")), d["uri"])
    )
    return _joined(described)


# --- links ----------------------------------------------------------------------------


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return links.link_procedures(sample.notices(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return links.resolved_outcomes(_links(spark, folder))


def _relinked(spark: SparkSession, folder: str) -> DataFrame:
    """Links after corrections: only the procedures whose notices were re-published are redone."""
    before = sample.tender_notices(spark, folder).unionByName(sample.award_notices(spark, folder))
    fixed = upsert.latest_rows(sample.notice_corrections(spark, folder), "publication_number", "landed")
    changes = fixed.select("publication_number", F.col("publication_date").alias("new_date"))
    after = before.join(changes, "publication_number", "left").select(
        *[
            F.coalesce("new_date", "publication_date").alias(name) if name == "publication_date" else F.col(name)
            for name in before.columns
        ]
    )
    touched = before.join(changes, "publication_number", "left_semi").select("procedure_id")
    linked = stored(links.link_procedures(before), "links")
    return links.relink(linked, after, stored(touched.distinct(), "touched"))


# --- notices and tenders from their landed form ------------------------------------------


def _flat_notices(notices: DataFrame) -> DataFrame:
    return notices.select(
        "publication_number",
        "notice_type",
        "kind",
        "procedure_id",
        "is_eforms",
        _joined("cpv").alias("cpv"),
        "cpv_primary",
        "buyer_name",
        "title",
        "publication_date",
        "deadline",
        F.round("estimated_value", 2).alias("estimated_value"),
        _joined("winner_names").alias("winner_names"),
        _joined("winner_selection_status").alias("winner_selection_status"),
        "award_outcome",
        _joined(F.transform("tender_values", lambda value: F.round(value * 100).cast("bigint").cast("string"))).alias(
            "tender_values_in_cents"
        ),
        F.round("result_value", 2).alias("result_value"),
    )


def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    pages = sample.notice_pages(spark, folder)
    hits = pages.select(F.explode(notice_pages.hits_from_text(F.col("value"))).alias("notice"))
    return _flat_notices(require_keyed(normalize_notices(hits)))


_LANDED: dict[tuple[str, str, str], str] = {}

# A compressed file is read by one task, so that pages are landed in many of a few MB.
PAGES_A_FILE = 20_000


def _landed(spark: SparkSession, folder: str, purpose: str, write: Callable[[str], None]) -> str:
    """Where the sample pages of a folder have been landed; a session lands them once."""
    key = (spark.sparkContext.applicationId, folder, purpose)
    if key not in _LANDED:
        path = shared_folder(spark, purpose)
        write(path)
        _LANDED[key] = path
    return _LANDED[key]


def _scanned_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = sample.notice_pages(spark, folder).write.option("maxRecordsPerFile", PAGES_A_FILE)
    packed = pages.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    path = _landed(spark, folder, "notice-pages", packed.text)
    hits = notice_pages.scan_pages(spark, path, page_per_line=True)
    return _flat_notices(require_keyed(normalize_notices(hits.select("notice"))))


def _flat_tenders(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "entry_id",
        "expediente",
        "title",
        F.round("budget", 2).alias("budget"),
        "cpv_primary",
        "deadline",
        _joined_documents("documents").alias("documents"),
    )


def _parsed_from_text(spark: SparkSession, folder: str) -> DataFrame:
    return tenders.parse_entries(tender_feed.read_entries(sample.feed_entries(spark, folder).select("entry")))


def _scanned_entries(spark: SparkSession, folder: str) -> DataFrame:
    pages = sample.feed_pages(spark, folder).write.option("maxRecordsPerFile", 1)
    path = _landed(spark, folder, "feed-pages", pages.text)
    return _flat_tenders(tenders.parse_entries(tender_feed.scan_entries(spark, path)).drop("landed"))


def _feed_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction scored against the feed itself, from entry text and landed documents to accuracy."""
    landed = sample.landed_documents(spark, folder).select("uri", documents.is_pdf(F.col("content")).alias("is_pdf"))
    gradable = search.gradable_tenders(_parsed_from_text(spark, folder))
    return _rounded(grading.feed_evaluation(gradable, landed, sample.extractions(spark, folder)), "accuracy")


# --- decisions and scores ------------------------------------------------------------------


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return eligibility.check_bids(
        sample.bids(spark, folder),
        sample.tenders(spark, folder),
        sample.profiles(spark, folder),
        sample.requirements(spark, folder),
    )


def _explained(verdicts: DataFrame) -> DataFrame:
    return eligibility.explain_verdicts(verdicts).select(
        "tender_id",
        "company",
        "verdict",
        _joined("blocking_reasons").alias("blocking_reasons"),
        _joined("confirm_by_hand").alias("confirm_by_hand"),
    )


def _one_company(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = eligibility.check_company(
        sample.tenders(spark, folder), ONE_COMPANY, sample.requirements(spark, folder)
    )
    return _explained(verdicts)


def _family_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Tenders are dealt out first: the companies are broadcast, and pairs are formed in the tasks that read tenders."""
    listed = sample.tenders(spark, folder).select("entry_id", "cpv_primary")
    return families.family_pairs(spread(listed), sample.profiles(spark, folder))


def _family_verdicts(spark: SparkSession, folder: str, counted: bool = False) -> DataFrame:
    return eligibility.check_families(
        sample.tenders(spark, folder),
        sample.profiles(spark, folder),
        sample.requirements(spark, folder),
        counted=counted,
    )


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    return grading.truth_fields(tenders.as_notices(sample.tenders(spark, folder)))


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return grading.grade_extractions(_truth(spark, folder), sample.extractions(spark, folder)).select(
        "tender_id", "field", "grade"
    )


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in names})


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.pair_predictions(sample.predictions(spark, folder), _resolved(spark, folder))


def _upserted_notices(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("publication_number", "publication_date", "estimated_value", "title")
    return upsert.upsert(
        sample.tender_notices(spark, folder).select(*columns),
        sample.notice_corrections(spark, folder),
        "publication_number",
        "landed",
    )


def _upserted_tenders(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.upsert(
        sample.tenders(spark, folder).select("entry_id", "title", "budget", "deadline"),
        upsert.keyed_tenders(sample.tender_corrections(spark, folder)),
        "entry_id",
        "landed",
    )


def _marked_tenders(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.upsert_marked(
        sample.tenders(spark, folder).select("entry_id", "title", "budget", "deadline"),
        upsert.keyed_tenders(sample.tender_corrections(spark, folder)),
        sample.deletion_marks(spark, folder),
        "entry_id",
        "landed",
    )


def _lag_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Number of lags in the merged sketch, and whether the share of lags up to its median is half, give or take 3 percent
    and the links that have just that lag."""
    linked = _links(spark, folder).where(F.col("lag_days").isNotNull())
    found = monitoring.approximate_median_lag(monitoring.lag_sketches(linked)).first()
    lag, half = F.col("lag_days"), F.lit(found["median_lag_days"])
    return linked.agg(
        F.lit(found["n"]).cast("bigint").alias("n"),
        ((F.count_if(lag < half) <= 0.53 * found["n"]) & (F.count_if(lag <= half) >= 0.47 * found["n"])).alias("within_bound"),
    )


def _asked_in_sql(spark: SparkSession, folder: str, question: str) -> DataFrame:
    """A question to the table functions over the sample tables."""
    for name in ("tenders", "notices", "requirements"):
        getattr(sample, name)(spark, folder).createOrReplaceTempView(name)
    sql_functions.register_functions(spark)
    return spark.sql(question)


SQL_QUESTIONS = {
    "sql_search_tenders": f"""
        SELECT * FROM search_tenders('{SEARCH_FAMILY}', max_budget => {HIGHEST_BUDGET}, min_budget => {LOWEST_BUDGET})""",
    "sql_past_awards": f"""
        SELECT notice, title, award_value_eur, array_join(winners, '|') AS winners, outcome
        FROM past_awards('{FAMILY}')""",
    "sql_award_outcome_counts": f"SELECT * FROM award_outcome_counts('{FAMILY}')",
    "sql_company_eligibility": """
        SELECT tender_id, verdict, scope, solvency, certification, capacity
        FROM company_eligibility(array('1', '45'), 300000.0D, array('iso 9001'), 950000.0D)""",
}


def _window(spark: SparkSession, folder: str) -> DataFrame:
    return sample.tender_notices_by_country(spark, folder).where(
        notice_pages.source_window("tender", *WINDOW, country=COUNTRY)
    )


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Links after a second landing, from those of the first; equal to links of all that then holds."""
    before = stored(sample.notices(spark, folder), "notices")
    linked = stored(links.link_procedures(before), "links")
    return apply_batch(before, linked, sample.second_landing(spark, folder, before))[1]


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Links and their tender notices after two batches have been stored, the second of them twice, as after the loss
    of a driver."""
    root = shared_folder(spark, "ingested")
    ingest.store_notices(root, sample.notices(spark, folder).withColumn("landed", F.lit(0)), 0)
    for _ in range(2):
        ingest.store_notices(root, sample.second_landing(spark, folder), 1)
    notice = ingest.notices_table(root).read(spark).withColumnRenamed("publication_number", "tender_pub")
    return ingest.links_table(root).read(spark).join(
        notice.select("tender_pub", "title", "estimated_value"), "tender_pub"
    )


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Tender notices in folders by kind and month, after some of them moved to another day."""
    table = folder_table.monthly_notices(shared_folder(spark, "monthly"))
    table.upsert(sample.tender_notices(spark, folder).withColumn("landed", F.lit(0)), "landed", 0)
    table.upsert(sample.second_landing(spark, folder).where(F.col("kind") == TENDER), "landed", 1)
    return table.read(spark).select("publication_number", "procedure_id", "publication_date", "estimated_value")


def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """How many hits of a window are taken in, and how many without a number are set aside."""
    return monitoring.intake_counts(select_window(sample.unnumbered_hits(spark, folder), *WINDOW))


def _search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_tenders(
        sample.tenders(spark, folder), SEARCH_FAMILY, max_budget=HIGHEST_BUDGET, min_budget=LOWEST_BUDGET
    )


def _details(found: DataFrame) -> DataFrame:
    return found.withColumn("document_links", _joined_documents("document_links"))


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Details of the tenders that anyone has bid on."""
    wanted = sample.table(spark, folder, "lineitem")
    keys = wanted.select(F.concat(F.lit("PT-"), F.col("l_partkey").cast("string")).alias("tender_id"))
    return _details(search.get_tenders(sample.tenders(spark, folder), keys))


def queries() -> dict[str, Query]:
    from_notices = {
        "link_outcomes": lambda s, d: links.link_outcomes(_links(s, d)),
        "median_lag": lambda s, d: links.median_lag(_links(s, d)),
        "award_procedures": lambda s, d: links.award_procedures(sample.notices(s, d)),
        "backfill_worklist": lambda s, d: links.backfill_worklist(sample.notices(s, d)),
        "ingest_watermarks": lambda s, d: monitoring.ingest_watermarks(sample.notices(s, d)),
        "ingest_counts": lambda s, d: monitoring.ingest_counts(sample.notices(s, d)),
        "dataset_report": lambda s, d: monitoring.dataset_report(sample.notices(s, d), _links(s, d)),
        "eforms_coverage": lambda s, d: _rounded(
            monitoring.eforms_coverage(sample.notices(s, d)), "eforms_fraction"
        ),
        "award_outcome": lambda s, d: sample.award_notices(s, d).select("publication_number", "award_outcome"),
        "classify_notices": lambda s, d: sample.mixed_notice_types(s, d).withColumn(
            "kind", notice_kind(F.col("notice_type"))
        ),
        "past_awards": lambda s, d: search.past_awards(sample.notices(s, d), FAMILY).withColumn(
            "winners", _joined("winners")
        ),
        "award_outcome_counts": lambda s, d: search.award_outcome_counts(sample.notices(s, d), FAMILY),
        "all_opportunities": lambda s, d: tenders.all_opportunities(
            sample.notices(s, d), sample.tenders(s, d)
        ).select(
            "publication_number",
            "procedure_id",
            "is_eforms",
            _joined("cpv").alias("cpv"),
            "title",
            "publication_date",
            "deadline",
            F.round("estimated_value", 2).alias("estimated_value"),
        ),
    }
    from_tenders = {
        "search_tenders": _search,
        "search_all_tenders": lambda s, d: search.search_tenders(sample.tenders(s, d), limit=50),
        "get_tender": lambda s, d: _details(search.get_tender(sample.tenders(s, d), ONE_TENDER)),
        "get_tenders": _delivered,
        "document_links": lambda s, d: search.document_links(sample.tenders(s, d)),
        "tender_doc_coverage": lambda s, d: search.document_coverage(sample.tenders(s, d)),
        "gradable_tenders": lambda s, d: search.gradable_tenders(sample.tenders(s, d)),
        "conform_tenders": lambda s, d: tenders.as_notices(sample.tenders(s, d)).select(
            "publication_number",
            "notice_type",
            "kind",
            "is_eforms",
            _joined("cpv").alias("cpv"),
            "cpv_primary",
            "title",
            "estimated_value",
            "deadline",
        ),
    }
    decisions = {
        "eligibility_verdicts": lambda s, d: _verdicts(s, d).select("tender_id", "company", "verdict"),
        "eligibility_checks": lambda s, d: eligibility.check_rows(_verdicts(s, d)),
        "eligibility_reasons": lambda s, d: _explained(_verdicts(s, d)),
        "verdict_counts": lambda s, d: eligibility.verdict_counts(_verdicts(s, d)),
        "company_eligibility": _one_company,
        "family_pairs": _family_pairs,
        "family_sizes": lambda s, d: _rounded(
            families.family_sizes(sample.tenders(s, d), sample.profiles(s, d)), "budget"
        ),
        "family_verdicts": lambda s, d: _family_verdicts(s, d).select("tender_id", "company", "verdict"),
        "family_verdict_counts": lambda s, d: eligibility.verdict_counts(_family_verdicts(s, d, counted=True)),
    }
    scores = {
        "grade_extractions": _graded,
        "extraction_scorecard": lambda s, d: _rounded(
            grading.extraction_scorecard(_truth(s, d), sample.extractions(s, d)), "accuracy"
        ),
        "majority_baseline": lambda s, d: _rounded(backtest.majority_baseline(_pairs(s, d)), "accuracy"),
        "backtest_summary": lambda s, d: _rounded(
            backtest.backtest_summary(_pairs(s, d)), "accuracy", "baseline_accuracy", "lift"
        ),
        "backtest_per_class": lambda s, d: _rounded(
            backtest.backtest_per_class(_pairs(s, d)), "precision", "recall", "f1"
        ),
        "run_cost": lambda s, d: _rounded(
            cost.run_cost(sample.document_costs(s, d), RATES), "usd", "usd_per_document"
        ),
        "sniff_documents": lambda s, d: sample.document_contents(s, d).select(
            "doc_id", documents.is_pdf(F.col("content")).alias("is_pdf")
        ),
        "feed_scorecard": _feed_scorecard,
    }
    return {
        "procedure_links": _links,
        "resolved_outcomes": _resolved,
        "relink_procedures": _relinked,
        **from_notices,
        "ingest_window": _window,
        "ingest_quarantine": _quarantine,
        "incremental_dataset": _incremental,
        "ingested_links": _ingested,
        "monthly_notices": _monthly,
        **from_tenders,
        **decisions,
        **scores,
        "normalize_notices": _normalized,
        "parse_tenders": lambda s, d: _flat_tenders(_parsed_from_text(s, d)),
        "parse_tenders_anywhere": lambda s, d: _flat_tenders(
            tenders.parse_entries_anywhere(sample.feed_entries(s, d).select("entry"))
        ),
        "scan_ted_pages": _scanned_pages,
        "scan_atom_entries": _scanned_entries,
        "upsert_notices": _upserted_notices,
        "upsert_tenders": _upserted_tenders,
        "upsert_marked_tenders": _marked_tenders,
        "lag_sketch": _lag_sketch,
        **{
            name: lambda s, d, question=question: _asked_in_sql(s, d, question)
            for name, question in SQL_QUESTIONS.items()
        },
    }
